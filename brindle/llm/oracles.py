"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others are held against brute force, the tokenizer library or held-out labels in tests/llm:
SQL has no lookaround for operator 1, no XXH64 for operator 6, no parser, tokenizer or trained model.
"""

from __future__ import annotations

from . import lines, topk

SQL_op4_exact_topk = f"""
with good as (
  select vec_id, list_transform(embedding::double[], lambda x: floor({topk.SCALE} * x)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
    coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0)::bigint as score
  from good q join good c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 50 = 0
)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 5"""

SQL_op5_line_dedup = f"""
with parts as (
  select doc_id, source, text, string_split(text, chr(10)) as lines from documents where text is not null
), each_ as (
  select doc_id, source, n, lines[n + 1] as raw, trim(lines[n + 1], ' ' || chr(9) || chr(13)) as line
  from parts, unnest(range(len(lines))) r(n)
), wide as (
  select line, min((doc_id, n)) as first from each_ where line <> '' group by line having count(distinct source) >= {lines.MIN_SITES}
), kept as (
  select doc_id, count(*) as n_lines, sum((w.line is not null and w.first <> (doc_id, n))::int)::bigint as n_removed,
    coalesce(string_agg(raw, chr(10) order by n) filter (where w.line is null or w.first = (doc_id, n)), '') as text
  from each_ left join wide w using (line) group by doc_id
)
select doc_id, n_lines, n_removed, text from kept
union all select doc_id, 0, 0, null from documents where text is null"""

SQL_op8_source_mixing = r"""
with s as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint as place from documents
), src as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as turn from s group by source
), weighed as (
  select *, ([3.0, 0.5, 3.0]::double[])[1 + turn % 3] as a, ([3.0, 1.5, 1.0]::double[])[1 + turn % 3] as b,
    ([3.0, 1.0, 2.0]::double[])[1 + turn % 3] as weight, (select sum(source_size) from src)::double as everything from src
), placed as (
  select *, row_number() over (order by 2.0::double * source_size / weight, turn) as k from weighed
), summed as (
  select *, coalesce(sum(2.0::double * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0) as fixed,
    sum(weight) over (order by k rows between current row and unbounded following) as open_weight from placed
), level as (
  select (everything * 1.5::double - fixed) / open_weight as l from summed
  where 2.0::double * source_size / weight >= (everything * 1.5::double - fixed) / open_weight order by k limit 1
), targets as (
  select source, source_size, a, b, least(weight * l, 2.0::double * source_size) as target from weighed, level
), queue as (
  select s.doc_id, s.size, t.source_size, t.target, t.a, t.b, round(t.target)::bigint as total,
    coalesce(sum(s.size) over (partition by s.source order by s.place, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from s join targets t on s.source is not distinct from t.source
), passed as (
  select *, case when source_size > 0 then total // source_size else 0 end as passes from queue
), given as (
  select *, greatest(0, least(size, total - passes * source_size - before)) as part from passed
), timed as (
  select *, (b - a) / (a + b) as bend, case when size > 0 and (passes > 0 or part > 0) then before / total::double end as u1,
    case when size > 0 and (passes > 1 or passes = 1 and part > 0) then (before + source_size) / total::double end as u2 from given
)
select doc_id, size, source_size, target, (passes * size + part)::bigint as taken,
  round(case when a = b then u1 else (-(1 - bend) + sqrt((1 - bend) * (1 - bend) + 4 * bend * u1)) / (2 * bend) end, 9) as position,
  round(case when a = b then u2 else (-(1 - bend) + sqrt((1 - bend) * (1 - bend) + 4 * bend * u2)) / (2 * bend) end, 9) as second_position
from timed"""


SQL_op13_importance_resampling = r"""
with recursive crc(b, step, c) as (
  select b, 0, b::bigint from range(256) r(b)
  union all select b, step + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc where step < 8
), entries as (
  select list(c order by b) as entry from crc where step = 8
), docs as (
  select row_number() over () as id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
), items as (
  select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark
), said as (
  select id, unnest(words) as word from docs
), coded as (
  select word, hex(encode(word)) as code from (select word from said union select word from items)
), hashed as (
  select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(code) // 2 + 1), lambda i: ('0x' || substr(code, 2 * i - 1, 2))::bigint)),
    lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket from coded, entries
), ours as (
  select bucket, count(*) as s from said join hashed using (word) group by bucket
), theirs as (
  select bucket, count(*) as t from items join hashed using (word) group by bucket
), gains as (
  select bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from ours)::double + 10000)) / ((s + 1)::double * ((select coalesce(sum(t), 0) from theirs)::double + 10000))))::bigint as gain
  from ours left join theirs using (bucket)
), weighed as (
  select id, floor(sum(gain) / count(*))::bigint as weight from said join hashed using (word) join gains using (bucket) group by id
), scored as (
  select doc_id, len(words)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5)::double / 4294967296)))::bigint as score
  from docs left join weighed using (id)
), placed as (
  select *, row_number() over (order by (n_features < 20), score desc, doc_id nulls last, n_features) as place, (10 * count(*) filter (where n_features >= 20) over ()) // 100 as drawn from scored
)
select doc_id, n_features, weight, score::bigint as score, case when place <= drawn then place end as rank from placed"""


def oracle_sql() -> dict[str, str]:
    return {name[4:]: text for name, text in globals().items() if name.startswith("SQL_")}
