"""SQL for DuckDB that gives the rows of registered queries another way."""

from __future__ import annotations

NGRAM_JOIN = r"""
with recursive w as (
    select doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
s as (
    select doc_id, case when words is null or len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
        else list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) end as shingles
    from w),
n as (select doc_id, len(shingles) as n from s),
e as (select doc_id, unnest(shingles) as shingle from s),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as i from e a join e b on a.shingle = b.shingle and a.doc_id <> b.doc_id
    group by all),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b)
select doc_id, n as n_shingles, least(doc_id, coalesce((select min(b) from reach where a = doc_id), doc_id)) as component_id,
    (select count(*) from links where a = doc_id) as n_links
from n
"""

URL_FILTER = r"""
with u as (
    select page_id, case when url is not null and strpos(url, '://') > 0
                         then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (
    select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(rule_host, rule_path, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
select page_id, host, path,
    (select arg_max(rule_host || rule_path, length(rule_host || rule_path)) from r
     where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)) as rule,
    coalesce((select arg_max(verdict, length(rule_host || rule_path)) from r
     where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)), 'allow') as verdict
from p
"""

LINE_RULES = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from d),
v as (select doc_id, i, array_to_string(words[i:i + 7], ' ') as win
    from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from w)),
c as (select distinct doc_id, unnest(range(i, i + 8)) as place
    from (select doc_id, i, count(*) over (partition by doc_id, win) as n from v) where n > 1),
r as (select doc_id, count(*) as n_repeat_words from c group by 1),
l as (select doc_id, lines[i] as line, lines[i - 1] as before, lines[i + 1] as after
    from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from w)),
h as (select line from (select line, before, after, count(*) as n from l where length(line) < 200 group by all)
    group by line having count(*) >= 20 and count(*) * 1000 >= (select count(*) from documents) and count(*) * 2 >= sum(n)),
m as (select doc_id, line, line in (select line from h) as common, lower(trim(line, ' ')) as low, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) as chars,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) as symbols, length(regexp_replace(line, '[^|]', '', 'g')) as cells,
    length(regexp_replace(line, '[^!]', '', 'g')) as shouts,
    len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n from l),
f as (select doc_id, sum(n) as lost from m where symbols * 10 >= chars or (cells >= 3 and cells * 4 >= n)
    or (shouts >= 4 and shouts * 2 >= n)
    or length(line) <= 40 and low in ('home', 'menu', 'search', 'login', 'log in', 'sign in', 'sign up', 'register', 'next', 'previous',
        'back to top', 'read more', 'skip to content', 'share', 'print', 'contact', 'about', 'sitemap')
    or common
    or (length(line) < 200 and not regexp_matches(line, '[.!?…。！？]["'')\]}»”’]*[\x20\x09-\x0D]*\z'))
    or (length(line) < 200 and regexp_matches(low, 'javascript is disabled|enable javascript|lorem ipsum|all rights reserved|cookie policy|privacy policy|terms of use|terms of service|powered by'))
    group by 1),
o as (select w.doc_id, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(lost, 0)::bigint as n_lost_words
    from w left join r using (doc_id) left join f using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 100 * n_lost_words <= 50 * n_words as kept, n_lost_words
from o
"""
