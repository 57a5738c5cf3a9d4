"""SQL for DuckDB that gives the rows of the Merkle manifest and of the prefix trie another way."""

from __future__ import annotations

from citetrust.llm.merkle import FIELDS
from citetrust.llm.trie import FAMILY, MOST

LEVELS = 5  # of 16 nodes to one: enough for a million rows of a source, and a million sources


def _crc32(column: str) -> str:
    """crc32 of a number's decimal digits, bit by bit."""
    bit = "lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::bigint[]), {bit})"
    digits = f"list_transform(string_split({column}::varchar, ''), lambda d: ascii(d)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {digits}), {byte}), 4294967295)"


def _leaf(text: str) -> str:
    values = [text if c == "text" else f"{c}::varchar" for c in FIELDS]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({v})::varchar || ':' || {v}, '-')" for v in values) + "))"


def _levels(name: str, partition: str) -> tuple[list[str], str]:
    """CTEs of a tree over ``name``0 (g, i, h), and (g, i, lefts, rights) for a node ``l`` as a lateral select."""
    made = []
    for k in range(LEVELS):
        made += [
            f"{name}{k}n as (select *, count(*) over (partition by {partition}) as n from {name}{k})",
            f"{name}{k + 1} as (select g, i // 16 as i, case when any_value(n) = 1 then any_value(h)"
            f" else sha256(string_agg(h, '' order by i)) end as h from {name}{k}n group by g, i // 16)",
        ]
    sides = []
    for k in range(LEVELS):
        for side in "<>":
            sides.append(
                f"(select case when any_value(n) > 1 then coalesce(string_agg(h, '' order by i) filter (where i {side} l.i // {16**k}), '')"
                f" end from {name}{k}n s where s.g = l.g and s.i // 16 = l.i // {16 ** (k + 1)})"
            )
    lefts, rights = "[" + ", ".join(sides[0::2]) + "]", "[" + ", ".join(sides[1::2]) + "]"
    return made, f"{lefts} as lefts, {rights} as rights"


def merkle() -> str:
    down, upper_case, lower_case = "translate(text, '{0}', '{1}')", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lowered = _leaf(down.format(upper_case, lower_case))
    rows, row_paths = _levels("r", "g")
    tops, top_paths = _levels("t", "1")
    ctes = [
        f"d as (select doc_id, coalesce('1' || source, '0') as g, {_leaf('text')} as leaf,"
        f" case when {_crc32('doc_id')} % 5 = 0 then {lowered} end as changed from documents)",
        "e as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i from d)",
        "r0 as (select g, i, leaf as h from e)",
        *rows,
        f"subs as (select g, h, row_number() over (order by g) - 1 as i from r{LEVELS})",
        "t0 as (select 'all' as g, i, h from subs)",
        *tops,
        f"up as (select l.i, {top_paths} from t0 l)",
        f"own as (select l.g, l.i, {row_paths} from r0 l)",
        "p as (select e.doc_id, leaf, subs.h as subroot, coalesce(changed, leaf) as start,"
        " list_filter(list_zip(list_concat(own.lefts, up.lefts), list_concat(own.rights, up.rights)), lambda x: x[1] is not null) as path"
        " from e join own using (g, i) join subs using (g) join up on up.i = subs.i)",
        "f as (select *, sha256(coalesce(array_to_string(list_transform(path, lambda x: x[1] || x[2]), ''), '')) as proof_sha256,"
        " list_reduce(list_prepend({'a': start, 'b': ''}, list_transform(path, lambda x: {'a': x[1], 'b': x[2]})),"
        " lambda acc, x: {'a': sha256(x.a || acc.a || x.b), 'b': ''}).a as folded_root from p)",
    ]
    return (
        f"with {', '.join(ctes)} select doc_id, leaf, subroot, (select h from t{LEVELS}) as root, proof_sha256, folded_root,"
        f" folded_root = (select h from t{LEVELS}) as verified from f"
    )


def trie() -> str:
    return f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
s as (select *, sha256(strlen(role)::varchar || ':' || role || text) as said, strlen(text) as n_bytes from t),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, said) - 1 as i from s),
c as (select conv_id, conv_id - conv_id % {FAMILY} as base, {_crc32("conv_id")} % {MOST} as h, count(*) as n from n group by 1),
b as (select c.conv_id, c.base, c.h, c.n, least(c.h, coalesce(o.n, 0)) as taken from c left join c o on o.conv_id = c.base),
r as (select b.conv_id, n.i + 1 as depth, said, n_bytes from b join n on n.conv_id = b.base where n.i < taken
    union all select conv_id, taken + i - h + 1, said, n_bytes from b join n using (conv_id) where i >= h),
z as (select conv_id, taken + greatest(n - h, 0) as length from b),
p as (select conv_id, depth, n_bytes, sha256(string_agg(said, '') over (partition by conv_id order by depth)) as id from r
    union all select conv_id, 0, 0, '' from z),
m as (select depth, id, min(conv_id) as owner, count(*) as n_convs, min(n_bytes) as n_bytes from p group by 1, 2),
w as (select p.conv_id, p.depth, m.owner, m.n_convs, (m.n_convs - 1) * m.n_bytes as saved from p join m using (depth, id)),
u as (select w.owner as conv_id, w.depth, x.owner as parent_conv_id, any_value(w.n_convs) as n_convs, any_value(w.saved) as saved
    from w left join w x on x.conv_id = w.conv_id and x.depth = w.depth - 1 group by 1, 2, 3),
k as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from u where depth > 0 group by 1, 2),
v as (select u.*, coalesce(n_children, 0) as n_children from u left join k using (conv_id, depth)),
a as (select x.owner as conv_id, x.depth, sum((v.n_children = 0)::int) as n_leaves, sum(v.saved) as saved_tokens
    from v join w x on x.conv_id = v.conv_id and x.depth <= v.depth group by 1, 2),
e as (select owner as conv_id, depth, sha256(string_agg(z.conv_id::varchar, ',' order by z.conv_id)) as ends
    from z join w on w.conv_id = z.conv_id and w.depth = z.length group by 1, 2)
select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens,
    coalesce(ends, sha256('')) as ends_sha256
from v join a using (conv_id, depth) left join e using (conv_id, depth)
"""
