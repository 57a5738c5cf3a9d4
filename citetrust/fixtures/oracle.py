"""The queries as plain SQL for DuckDB, worked out relationally: one row per link, label or vote.

Nothing here shares logic with the operators; only the fixture text and the fixed citation patterns are the
same.
"""

from __future__ import annotations

from citetrust.fixtures.tables import PAGE_OF_RUN, PAGE_OF_USER, SUFFIXES, revisions_sql
from citetrust.functions.text import CITE, ISBN_FIELD, NOT_ISBN, REF, URL, URL_FIELD

EDGES = r"^[\x00-\x20]+|[\x00-\x20]*(?:\}\}|\]\])?[\x00-\x20]*\z"
HOST = r"(?i)^(?:https?|ftp|file)://(?:[^/?#@]*@)?([^/?#:@]*)(?::[0-9]*)?(?:[/?#]|\z)"
INLINE_REF = REF + r"\s*?\{\{\QDisputed inline\E"

RULES = ", ".join(f"('{rule}')" for rule in SUFFIXES)


def domains(links: str) -> str:
    """CTEs giving ``dom(link, domain)`` for the distinct links of a CTE."""
    return f"""
rules(rule) as (values {RULES}),
cleaned as (select link, regexp_replace(link, '{EDGES}', '', 'g') as url
            from (select distinct link from {links})),
hosts as (select link, lower(regexp_extract(url, '{HOST}', 1)) as host
          from cleaned where not contains(url, '{{{{')),
labelled as (select distinct host, string_split(host, '.') as labels from hosts
             where host <> '' and not regexp_matches(host, '^\\.|\\.\\.|\\.\\z')),
tails as (select host, labels, n, array_to_string(labels[len(labels) - n + 1:], '.') as tail
          from (select host, labels, unnest(range(1, len(labels) + 1)) as n from labelled)),
matched as (select t.host, t.labels,
            max(case when r.rule = '!' || tail then n - 1 end) as excepted,
            max(case when r.rule = tail then n when r.rule = '*.' || tail then n + 1 end) as suffix
            from tails t left join rules r on r.rule in (tail, '*.' || tail, '!' || tail)
            group by t.host, t.labels),
host_domain as (select host, case when len(labels) > m
                    then array_to_string(labels[len(labels) - m:], '.') end as domain
                from (select host, labels, coalesce(excepted, suffix, 1) as m from matched)),
dom as (select link, domain from hosts join host_domain using (host) where domain is not null)
"""


def texts(page: str = PAGE_OF_USER) -> str:
    """CTEs from the revisions to ``srcs(rev_id, src)``, the distinct sources of each revision."""
    return f"""
with revs as ({revisions_sql(page)}),
refs as (select rev_id, unnest(regexp_extract_all(text, '{REF}', 1)) as ref from revs),
cites as (select rev_id, unnest(regexp_extract_all(text, '{CITE}')) as cite from revs),
ref_links as (select rev_id, unnest(regexp_extract_all(ref, '{URL}')) as link from refs),
cite_links as (select rev_id, regexp_extract(cite, '{URL_FIELD}', 1) as link from cites),
isbns as (select rev_id, 'ISBN:' || digits as src from (
            select rev_id,
                regexp_replace(regexp_extract(cite, '{ISBN_FIELD}', 1), '{NOT_ISBN}', '', 'g') as digits
            from cites) where digits <> ''),
inline_links as (
    select rev_id, coalesce(nullif(g1, ''), g2) as link
    from (select rev_id, unnest(regexp_extract_all(text, '{INLINE_REF}', 1)) as g1,
              unnest(regexp_extract_all(text, '{INLINE_REF}', 2)) as g2 from revs)),
links as (select link from ref_links union select link from cite_links
          union select link from inline_links),
{domains("links")},
srcs as (select rev_id, domain as src from ref_links join dom using (link)
         union select rev_id, domain from cite_links join dom using (link)
         union select rev_id, src from isbns),
inline_srcs as (select distinct rev_id, domain as src from inline_links join dom using (link))
"""


def _has(template: str) -> str:
    low = template.lower()
    return f"(contains(lower(text), '{{{{{low}}}}}') or contains(lower(text), '{{{{{low}|'))"


def episodes(template: str, where: str = "true") -> str:
    """CTE ``ids(page_id, ta, tr, text_tr)``: where the template comes and first goes again."""
    return f"""
flags as (select page_id, rev_id, text, {_has(template)} as has from revs where {where}),
turns as (select * from (select *, coalesce(lag(has) over (partition by page_id order by rev_id), false)
                         as before from flags) where has <> before),
ids as (select * from (
            select page_id, has, rev_id as ta,
                lead(rev_id) over (partition by page_id order by rev_id) as tr,
                lead(text) over (partition by page_id order by rev_id) as text_tr from turns)
        where has and tr is not null)
"""


def block_pairs(page: str = PAGE_OF_USER, where: str = "true") -> str:
    """CTEs up to ``pairs(page_id, ta, tr)`` and ``revisions`` with their sources in ``srcs``."""
    return f"""{texts(page)}, {episodes("Disputed", where)},
pairs as (select page_id, ta, tr from ids where tr in (select rev_id from srcs)),
revisions as (select ta as revision_id, tr as pair_id, page_id, true as ta, false as tr from pairs
              union all select tr, ta, page_id, false, true from pairs)
"""


LISTS = "lists as (select rev_id, string_agg(src, ' ' order by src) as src from srcs group by rev_id)"
FLAT_PAIRS = """
select page_id, p.ta as rev_id_ta, p.tr as rev_id_tr,
    coalesce(a.src, '') as src_ta, coalesce(r.src, '') as src_tr
from pairs p left join lists a on a.rev_id = p.ta left join lists r on r.rev_id = p.tr
"""
INLINE_PAIRS = """
votes as (select page_id, ta, tr, src, contains(text_tr, src) as kept
          from ids join inline_srcs on rev_id = ta)
select page_id, ta as rev_id_ta, tr as rev_id_tr, string_agg(src, ' ' order by src) as src_ta,
    string_agg(src, ' ' order by src) filter (where kept) as src_tr
from votes group by all having bool_or(kept)
"""
SPLIT = "(select cast(floor(max(event_id) * 7 / 10) as bigint) from events)"
IN_DUMP = "page_id % 7 not in (3, 5)"


def flat_revisions(ta: str = "ta", tr: str = "tr") -> str:
    return f"""
select revision_id, pair_id, page_id, {ta} as ta, {tr} as tr, ta as ta_gt, tr as tr_gt,
    coalesce(src, '') as src
from revisions left join lists on rev_id = revision_id
"""


MASKED = flat_revisions(f"ta and revision_id < {SPLIT}", f"tr and revision_id < {SPLIT}")
CLEANED = r"regexp_replace(split_part(src, '|', 1), '[\[\]{}()]', '', 'g')"


def sides(src: str = "src", pairs: str = "pairs") -> str:
    return f"""
sides as (select src, in_ta, in_tr from (
    select ta, tr, src, bool_or(side = 'ta') as in_ta, bool_or(side = 'tr') as in_tr from (
        select ta, tr, {src} as src, 'ta' as side from {pairs} join srcs on rev_id = ta
        union all select ta, tr, {src}, 'tr' from {pairs} join srcs on rev_id = tr)
    group by ta, tr, src))
"""


def ratio(part: str, total: str) -> str:
    return f"cast(cast(cast({part} as float) / cast({total} as float) as float) as double)"


def round4(number: str) -> str:
    return f"cast(cast(cast({number} as float) as double) as decimal(10, 4))"


def counted(added: str, removed: str, table: str) -> str:
    return f"""
counted as (select src, count(*) filter (where {added}) as added,
                count(*) filter (where {removed}) as removed from {table} group by src)
"""


CHANGES = counted("in_ta and not in_tr", "in_tr and not in_ta", "sides")
ESTIMATES = f"""
estimates as (select src, {round4(ratio("added", "added + removed"))} as p,
                  added + removed as occurrences
              from counted where added + removed > 0)
"""
FLAT_ESTIMATES = """
select src, cast(p as double) as p_added, cast(1 - p as double) as p_removed, occurrences from estimates
"""
UNCHANGED = f"""
counted as (select src, count(*) filter (where in_ta and not in_tr) as a,
                count(*) filter (where in_ta and in_tr) as u, count(*) as n from sides group by src)
select src, cast(pa as double) as p_added, cast(1 - pa - pu as double) as p_removed,
    cast(pu as double) as p_unchanged, n as occurrences
from (select src, n, {round4(ratio("a", "n"))} as pa, {round4(ratio("u", "n"))} as pu from counted)
"""
REVISION_VOTES = "cited as (select src, ta, tr from revisions join srcs on rev_id = revision_id)"


def votes(revisions: str, src: str = "src") -> str:
    """CTE ``votes``: one row per scored revision and source, or one with a null source."""
    return f"""
votes as (select revision_id, pair_id, s.src, e.src is not null as known,
              coalesce(cast(e.p as double), 0.5) as pa,
              coalesce(cast(1 - e.p as double), 0.5) as pr,
              coalesce(e.occurrences, 0) as n,
              100 - 100 * exp(-0.05 * least(coalesce(e.occurrences, 0), 100)) as w
          from {revisions} r left join (select rev_id, {src} as src from srcs) s on rev_id = revision_id
          left join estimates e on e.src = s.src)
"""


COMBINED = {
    "multiplicative": """cast(cast(product(pa) as float) as double) / nullif(
        cast(cast(product(pa) as float) as double) + cast(cast(product(pr) as float) as double), 0)""",
    "logarithmic": """case when bool_and(pa >= 0.999999) then 1 when bool_and(pr >= 0.999999) then 0
        when sum(pa) = 0 or sum(pr) = 0 then null when sum(pa) + sum(pr) <= 1e-5 then 0.5
        else sum(pa) / (sum(pa) + sum(pr)) end""",
    "weighted": """case when bool_and(pa >= 0.999999) then 1 when bool_and(pr >= 0.999999) then 0
        when sum(w) < 0.001 then 0.5 else sum(pa * w) / sum(w) end""",
    "weighted_sure": """case when min(n) < 1 or count(*) < 3 then -0.5
        when bool_and(pa >= 0.999999) then 1 when bool_and(pr >= 0.999999) then 0
        when sum(w) < 0.001 then -0.5 else sum(pa * w) / sum(w) end""",
}


def scores(combiner: str) -> str:
    vector = f"case when count(src) = 0 then 0.5 else {COMBINED[combiner]} end"
    return f"""
scored as (select revision_id, pair_id, {round4(vector)} as p from votes group by revision_id, pair_id)
select revision_id, pair_id, cast(p as double) as p_added, cast(1 - p as double) as p_removed from scored
"""


AS_STORED = """
select revision_id, coalesce(cast(cast(p_added as decimal(10, 4)) as varchar), 'NaN') as p_added,
    coalesce(cast(cast(p_removed as decimal(10, 4)) as varchar), 'NaN') as p_removed from final
"""


def nested(query: str) -> str:
    """A statement that begins with a CTE, for use inside another one."""
    return f"with {query}"


TRAIN_TEST = f"""
train as (select * from pairs where ta < {SPLIT}),
test_revs as (select * from revisions where (case when ta then revision_id else pair_id end) >= {SPLIT})
"""
LEARNED = f"{TRAIN_TEST}, {sides(CLEANED, 'train')}, {CHANGES}, {ESTIMATES}"
LABELS = """
select revision_id, pair_id, case when ta then '1.0' else '0.0' end as "templateAdded",
    case when tr then '1.0' else '0.0' end as "templateRemoved" from revisions
"""
URL_FORMS = r"""
with forms as (
    select page_id, url, regexp_replace(url, '^https?://', '') as rest from pages),
links as (
    select page_id, 'plain' as form, url as link from forms
    union all select page_id, 'upper', upper(url) from forms
    union all select page_id, 'brackets', '  ' || url || ' }} ' from forms
    union all select page_id, 'paren', 'http://' || split_part(rest, '/', 1) || ')' from forms
    union all select page_id, 'piped', 'http://' || split_part(rest, '/', 1) || '|title=x' from forms
    union all select page_id, 'user_port', 'ftp://me:pw@' || split_part(rest, '/', 1) || ':21' from forms
    union all select page_id, 'template', url || '{{dead}}x' from forms
    union all select page_id, 'no_scheme', rest from forms
    union all select page_id, 'wildcard', 'https://a.b' || page_id || '.ck/x' from forms
    union all select page_id, 'exception', 'https://sub' || page_id || '.www.ck?x' from forms
    union all select page_id, 'suffix_only', 'http://co.uk/' from forms
    union all select page_id, 'deep', 'http://x.y.s' || page_id || '.sch.uk#f' from forms
    union all select page_id, 'one_label', 'http://localhost:8080/' from forms
    union all select page_id, 'empty_label', 'http://a..com/' from forms),
"""
UNKNOWN = """
per_revision as (select revision_id, pair_id, count(src) as cited,
                     count(src) filter (where not known) as unknown
                 from votes group by revision_id, pair_id)
select cast(count(*) as bigint) as revisions, count(*) filter (where unknown > 0) as with_unknown,
    round(100.0 * count(*) filter (where unknown > 0) / count(*), 6) as percentage,
    coalesce(round(avg(cast(unknown as double) / cited) filter (where unknown > 0), 6), 0)
        as mean_unknown_share
from per_revision
"""


def oracle() -> dict[str, str]:
    text, pairs = texts(), block_pairs()
    in_dump = block_pairs(PAGE_OF_RUN, IN_DUMP)
    stored = "select *, true as gt from masked union all "
    stored += "select * replace (ta as ta_gt, tr as tr_gt), false as gt from masked"
    voted = counted("ta", "tr and not ta", "cited")
    all_votes = counted("ta", "tr and not ta", "cited").replace("counted", "by_src", 1)
    early = f"""
        early as (select src, ta, tr from revisions join srcs on rev_id = revision_id
                  where revision_id < {SPLIT}),
        late as (select * from revisions where revision_id >= {SPLIT})"""

    def scored(combiner: str, src: str = "src") -> str:
        return f"{pairs}, {LEARNED}, {votes('test_revs', src)}, {scores(combiner)}"

    return {
        "dump_pairs": f"{in_dump}, {LISTS} {FLAT_PAIRS}",
        "dump_pairs_inline": f"{texts(PAGE_OF_RUN)}, {episodes('Disputed inline', IN_DUMP)}, "
        f"{INLINE_PAIRS}",
        "dump_revisions": f"{in_dump}, {LISTS} {flat_revisions()}",
        "jobs_end_to_end": f"{in_dump}, {LEARNED}, {votes('test_revs')}, "
        f"final as ({nested(scores('weighted_sure'))}) {AS_STORED}",
        "template_present": f"with revs as ({revisions_sql()}) select rev_id, "
        f"{_has('Disputed')} as block, {_has('Disputed inline')} as inline from revs",
        "registrable_domain": f"{URL_FORMS} {domains('links')} "
        "select page_id, form, domain from links left join dom using (link)",
        "src_ref_urls": f"{text} select rev_id, domain as src from ref_links join dom using (link)",
        "src_cite_urls": f"{text} select rev_id, domain as src from cite_links join dom using (link)",
        "src_isbns": f"{text} select rev_id, src from isbns",
        "src_inline": f"{text} select rev_id, src from inline_srcs",
        "extract_sources": f"{text} select rev_id, src from srcs",
        "cleanup_source": f"{text}, found as (select rev_id, domain as src from ref_links "
        f"join dom using (link)) select rev_id, src, {CLEANED} as cleaned from found",
        "pairs_block": f"{pairs}, {LISTS} {FLAT_PAIRS}",
        "pairs_block_rare": f"{pairs}, {LISTS} {FLAT_PAIRS}",
        "pairs_inline": f"{text}, {episodes('Disputed inline')}, {INLINE_PAIRS}",
        "pairs_to_revisions": f"{pairs}, {LISTS} {flat_revisions()}",
        "train_split": f"{pairs}, {LISTS} {FLAT_PAIRS} where p.ta < {SPLIT}",
        "test_split": f"{pairs}, {LISTS} {flat_revisions()} "
        f"where (case when revisions.ta then revision_id else pair_id end) >= {SPLIT}",
        "labels": f"{pairs} {LABELS}",
        "mask_labels": f"{pairs}, {LISTS} {MASKED}",
        "pairs_roundtrip": f"{pairs}, {LISTS} {FLAT_PAIRS}",
        "revisions_roundtrip": f"{pairs}, {LISTS}, masked as ({MASKED}) {stored}",
        "source_probs_roundtrip": f"{pairs}, {sides(CLEANED)}, {CHANGES}, {ESTIMATES} {FLAT_ESTIMATES}",
        "source_probs_unchanged_roundtrip": f"{pairs}, {sides()}, "
        f"three_way as ({nested(UNCHANGED)}) select src, p_added, round(1 - p_added, 4) as p_removed, "
        "occurrences from three_way",
        "revision_probs_roundtrip": f"{pairs}, {LEARNED}, {votes('test_revs')}, "
        f"final as ({nested(scores('multiplicative'))}) {AS_STORED}",
        "source_eval_revisions": f"{pairs}, {REVISION_VOTES}, {voted}, {ESTIMATES} {FLAT_ESTIMATES}",
        "source_eval_pairs": f"{pairs}, {sides()}, {counted('not in_tr', 'in_tr', 'sides')}, "
        f"{ESTIMATES} {FLAT_ESTIMATES}",
        "source_eval_changed": f"{pairs}, {sides(CLEANED)}, {CHANGES}, {ESTIMATES} {FLAT_ESTIMATES}",
        "source_eval_with_unchanged": f"{pairs}, {sides()}, {UNCHANGED}",
        "occurrence_weight": f"{pairs}, {REVISION_VOTES}, {all_votes} "
        "select src, added + removed as occurrences, "
        "round(100 - 100 * exp(-0.05 * least(added + removed, 100)), 6) as weight from by_src",
        "is_undecided": f"{pairs}, {REVISION_VOTES}, {all_votes} "
        f"select src, abs({ratio('added', 'added + removed')} - {ratio('removed', 'added + removed')})"
        " < 1e-4 as undecided from by_src",
        "combine_multiplicative": scored("multiplicative"),
        "combine_logarithmic": scored("logarithmic"),
        "combine_weighted": scored("weighted"),
        "combine_weighted_sure": scored("weighted_sure", CLEANED),
        "score_pairs": scored("weighted_sure"),
        "score_revisions": f"{pairs}, {early}, {counted('ta', 'tr and not ta', 'early')}, {ESTIMATES}, "
        f"{votes('late')}, {scores('weighted_sure')}",
        "count_source_changes": f"{pairs}, {LISTS}, flat as ({FLAT_PAIRS}) "
        "select count(*) filter (where src_ta <> src_tr) as changed, "
        "count(*) filter (where src_ta = src_tr) as unchanged from flat",
        "count_unknown_sources": f"{pairs}, {LEARNED}, {votes('test_revs')}, {UNKNOWN}",
    }
