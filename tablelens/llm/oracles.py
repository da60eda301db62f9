"""SQL for the queries that SQL can express over clean tables."""

from __future__ import annotations

EMBEDDINGS = """
with recursive unit as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings where label is not null),
links as (
  select a.vec_id as a, b.vec_id as b from unit a join unit b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93),
reach as (
  select a, b from links
  union
  select r.a, l.b from reach r join links l on r.b = l.a),
low as (select a, min(b) as b from reach group by a),
many as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(m.n, 0)::bigint as n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) as kept
from embeddings e left join low l on l.a = e.vec_id left join many m on m.a = e.vec_id
"""

# Lines are compared by their words; two lines of six words or more are one
# word apart if what remains between their common front and back is at most
# one word on either side.  They then share a half, which joins them.
LINES = r"""
with split as (select doc_id, string_split(text, chr(10)) as l from documents),
numbered as (select doc_id, unnest(range(len(l))) as line, unnest(l) as s from split),
worded as (
  select doc_id, line, list_filter(regexp_split_to_array(s, '[ \x09-\x0D]+'), lambda x: x <> '') as w from numbered),
lines as (select * from worded where len(w) > 0),
firsts as (select w, min({'d': doc_id, 'l': line}) as first from lines group by w),
halves as (
  select w, first, unnest(list_distinct([
    'f' || array_to_string(w[:len(w) // 2], ' '), 'f' || array_to_string(w[:(len(w) - 1) // 2], ' '),
    'b' || array_to_string(w[len(w) // 2 + 1:], ' '), 'b' || array_to_string(w[len(w) - len(w) // 2 + 1:], ' ')])) as k
  from firsts where len(w) >= 6),
pairs as (
  select distinct a.w as a, b.w as b, a.first from halves a join halves b on a.k = b.k and b.first < a.first
  where abs(len(a.w) - len(b.w)) <= 1),
ends as (
  select *, least(len(a), len(b)) as short,
    list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false) as f,
    list_position(list_transform(range(1, least(len(a), len(b)) + 1),
      lambda i: list_reverse(a)[i] = list_reverse(b)[i]), false) as r
  from pairs),
near as (
  select distinct first from ends
  where greatest(len(a), len(b)) - least(short, coalesce(f - 1, short) + coalesce(r - 1, short)) <= 1),
dropped as (
  select l.doc_id, l.line, false as near from lines l join firsts f on f.w = l.w
  where f.first.d <> l.doc_id or f.first.l <> l.line
  union all select first.d, first.l, true from near),
per as (
  select doc_id, count(*) filter (not near) as n_repeated, count(*) filter (near) as n_near,
    list_sort(list(line::integer)) as dropped from dropped group by doc_id)
select s.doc_id, len(s.l)::bigint as n_lines, coalesce(p.n_repeated, 0)::bigint as n_repeated,
  coalesce(p.n_near, 0)::bigint as n_near, coalesce(p.dropped, []::integer[]) as dropped
from split s left join per p on p.doc_id = s.doc_id
"""

# CRC-32 from its polynomial, over the distinct words; then counts by bucket,
# gains, floored means, noise from SHA-256 and the highest scores.
IMPORTANCE = r"""
with crc as (
  select list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as t),
texts as (
  select 'd' as kind, doc_id, text from documents union all select 'b', null, text from benchmark),
split as (
  select kind, doc_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words from texts),
each as (select kind, doc_id, unnest(words) as w from split),
hexed as (select w, hex(encode(w)) as h from (select distinct w from each)),
bucket as (
  select w, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::bigint),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295) % 10000 as b from hexed, crc),
counts as (
  select b, count(*) filter (kind = 'd') as s, count(*) filter (kind = 'b') as t from each join bucket using (w) group by b),
sizes as (select sum(s)::bigint as s, sum(t)::bigint as t from counts),
gains as (
  select b, floor(1000 * ln((c.t + 1)::double * (z.s + 10000) / ((c.s + 1)::double * (z.t + 10000))))::bigint as gain
  from counts c, sizes z),
sums as (
  select doc_id, sum(gain) as total from each join bucket using (w) join gains using (b) where kind = 'd' group by doc_id),
scored as (
  select p.doc_id, len(words)::bigint as n_features,
    coalesce(floor(total::double / len(words)), 0)::bigint as weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || p.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as noise
  from split p left join sums using (doc_id) where kind = 'd'),
ranked as (
  select doc_id, row_number() over (order by weight + noise desc, doc_id) as place, count(*) over () as n
  from scored where n_features >= 20)
select s.doc_id, n_features, weight, weight + noise as score,
  case when place <= 10 * n // 100 then place end::bigint as rank
from scored s left join ranked r using (doc_id)
"""


def clusters(rounds: int = 5, k: int = 40) -> str:
    """Lloyd's rounds in whole numbers, one pair of expressions a round."""
    nearest = lambda r: f"""
a{r} as (
  select vec_id, v, arg_min(c, (d, c)) as c, min(d) as d from (
    select vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from kept, c{r}) group by vec_id, v)"""  # noqa: E731
    steps = [f"""
with kept as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 as (
  select row_number() over (order by sha256('2:' || vec_id)) - 1 as c, v as m from kept
  qualify c < {k})"""]
    for r in range(rounds):
        steps.append(nearest(r))
        steps.append(f"""
s{r} as (
  select c, i, sum(x)::bigint as s, count(*) as n from (select c, unnest(v) as x, unnest(range(64)) as i from a{r}) group by c, i),
m{r} as (
  select c, list((s - ((s % n) + n) % n) // n order by i) as m from s{r} group by c),
c{r + 1} as (select c, coalesce(m{r}.m, c{r}.m) as m from c{r} left join m{r} using (c))""")
    steps.append(nearest(rounds))
    return ",".join(steps) + f"""
select vec_id, c::integer as cluster, d as distance, sum(d) over (partition by c)::bigint as cluster_inertia,
  sum(d) over ()::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from a{rounds} join c{rounds} using (c)
"""


CLUSTERS = clusters()
