"""SQL of names that are close, from the definitions: normal forms, ratios and all similar pairs."""


def norm(x):
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def lcs(a, b):
    """Length of the longest common subsequence of strings of at most 60 characters, by bits."""
    masks = f"list_transform(range(1, length({b}) + 1), lambda j: coalesce(list_sum(list_transform(range(1, length({a}) + 1), lambda i: case when substr({a}, i, 1) = substr({b}, j, 1) then 1::bigint << (i - 1)::int else 0::bigint end)), 0)::bigint)"
    full = f"((1::bigint << length({a})::int) - 1)"
    return f"(length({a}) - bit_count(list_reduce(list_prepend({full}, {masks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})))"


def near(a, b):
    return f"case when length({a}) + length({b}) = 0 then 1.0::double when length({a}) = 0 or length({b}) = 0 then 0.0::double else 2 * {lcs(a, b)} / (length({a}) + length({b}))::double end"


def in_order(x):
    return f"list_sort(list_filter(string_split({x}, ' '), lambda t: t <> ''))"


def alike(table, out):
    """SQL that adds ``confidence`` to rows with nrm and rn: the closest of four comparisons."""
    joined = lambda x: f"array_to_string({x}, ' ')"
    cuts = lambda s, l: f"list_transform(range(2 - length({s}), length({l}) + 1), lambda i: substr({l}, greatest(i, 1), least(i + length({s}) - 1, length({l})) - greatest(i, 1) + 1))"
    return f""", {out}_0 as (select *, row_number() over () as k, list_sort(list_distinct({in_order('nrm')})) as la, list_sort(list_distinct({in_order('rn')})) as lb,
  case when length(nrm) <= length(rn) then nrm else rn end as short, case when length(nrm) <= length(rn) then rn else nrm end as long from {table}),
{out}_1 as (select *, list_sort(list_intersect(la, lb)) as shared, list_filter(la, lambda t: not list_contains(lb, t)) as xa, list_filter(lb, lambda t: not list_contains(la, t)) as xb from {out}_0),
{out}_2 as (select *, {joined('shared')} as sh, {joined('list_concat(shared, xa)')} as sx, {joined('list_concat(shared, xb)')} as sy, {joined(in_order('nrm'))} as ta, {joined(in_order('rn'))} as tb from {out}_1),
{out}_w as (select k, short as s, unnest({cuts('short', 'long')}) as w from {out}_0 where short <> '' union all select k, long, unnest({cuts('long', 'short')}) from {out}_0 where short <> '' and length(short) = length(long)),
{out}_p as (select k, max({near('s', 'w')}) as part from {out}_w group by k),
{out}_3 as (select * exclude (k, la, lb, shared, xa, xb, sh, sx, sy, ta, tb, short, long, part), {near('nrm', 'rn')} as ratio, {near('ta', 'tb')} as token_sort,
  case when len(shared) > 0 and (len(shared) = len(la) or len(shared) = len(lb)) then 1.0::double
       else greatest({near('sx', 'sy')}, case when sh <> '' then greatest({near('sh', 'sx')}, {near('sh', 'sy')}) else 0.0::double end) end as token_set,
  case when length(short) = 0 then case when length(long) = 0 then 1.0::double else 0.0::double end else part end as partial
  from {out}_2 left join {out}_p using (k)),
{out} as (select *, round(greatest(ratio, token_sort, token_set, partial), 6) as confidence from {out}_3)"""


def similar(left, right):
    """SQL of the pairs (l, r) of left (l, name) and right (r, name) whose sets of three-character
    stretches, repeats numbered, have a Jaccard similarity of 0.7 or more: all pairs that share any are counted."""
    form = lambda x: f"array_to_string({in_order(norm(x))}, ' ')"
    grams = "case when length(m) > 3 then list_transform(range(1, length(m) - 1), lambda i: substr(m, i, 3)) else [m] end"
    numbered = lambda x, c: f"select {c}, n, k, row_number() over (partition by {c}, k) as o from (select {c}, len(g) as n, unnest(g) as k from {x})"
    return f""", fl as (select l, {grams} as g from (select l, {form('name')} as m from {left}) where m <> ''),
fr as (select r, {grams} as g from (select r, {form('name')} as m from {right}) where m <> ''),
gl as ({numbered('fl', 'l')}), gr as ({numbered('fr', 'r')}),
close_pairs as (select l, r from (select l, r, gl.n as n, gr.n as m, count(*) as c from gl join gr using (k, o) group by all) where c >= 0.7::double * (n + m - c) - 1e-9)"""
