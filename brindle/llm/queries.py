"""Queries and SQL of the corpus operators; the entry module adds them if this subpackage is there."""

from __future__ import annotations

from .decontam import op2_decontamination
from .mixing import op3_mix
from .near_dedup import op4_near_dedup
from .quality import op10_quality
from .sharding import op7_shards
from .substring_dedup import op5_substring_dedup
from .token_files import op6_token_files
from .toxicity import op9_toxicity
from .url_rules import op8_url_rules
from .warc import op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_decontamination": op2_decontamination,
    "op3_mix": op3_mix,
    "op4_near_dedup": op4_near_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_files": op6_token_files,
    "op7_shards": op7_shards,
    "op8_url_rules": op8_url_rules,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
}

_URL_PARTS = r"""
u as (
  select page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages)
)"""

ORACLE = {
    "op1_warc": """
with d as (
  select page_id, url, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
    max(page_id) over (partition by coalesce(html, '')) as top from pages
)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> top then top end as refers_to, url as target_uri from d""",
    "op8_url_rules": "with "
    + _URL_PARTS.strip()
    + """,
r(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best as (
  select page_id, max({'a': length(h || p), 'b': length(h), 'rule': h || p, 'v': v}) as m
  from u join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id
)
select u.page_id, u.host, u.path, m.rule as rule, coalesce(m.v, 'allow') as verdict from u left join best using (page_id)""",
    "op3_mix": r"""
with d as (
  select doc_id, source, md5(cast(doc_id as varchar)) as k, md5(coalesce(text, '')) as tk,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents
), s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from d group by source
), w as (
  select *, [5, 2, 1][place % 3 + 1]::bigint as weight, sum(source_size) over () as total from s
), ranked as (
  select *, row_number() over (order by 2.0 * source_size / weight, place) as r from w
), level as (
  select coalesce(arg_min(lev, r), 1e300) as lev from (
    select r, 1.0::double * (1.5::double * total - coalesce(sum(2 * source_size) over before, 0)) / sum(weight) over after as lev,
      2.0 * source_size / weight as edge from ranked
    window before as (order by r rows between unbounded preceding and 1 preceding), after as (order by r rows between current row and unbounded following)
  ) where lev <= edge
), t as (
  select w.*, least(weight * lev, 2.0 * source_size)::double as target from w, level
), x as (
  select d.doc_id, d.size, t.source_size, t.target, t.place,
    coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.tk rows between unbounded preceding and 1 preceding), 0) as b
  from d join t on d.source is not distinct from t.source
), y as (
  select *, b + size / 2.0::double as m, case when size > 0 and b + size / 2.0::double < target then 1 else 0 end + case when size > 0 and b + source_size + size / 2.0::double < target then 1 else 0 end as copies from x
)
select doc_id, size, source_size, round(target, 6) as target, (size * copies)::bigint as taken, copies::integer as copies,
  case when copies > 0 then round(case place % 3
    when 0 then 2 * (m / target) / (1.5::double + sqrt(greatest(2.25::double - 2 * (m / target), 0)))
    when 1 then m / target
    else 2 * (m / target) / (0.5::double + sqrt(greatest(0.25::double + 2 * (m / target), 0))) end, 9) end as position
from y""",
    # by content, so that the SQL needs no candidate search: all pairs that share a shingle
    "op4_near_dedup": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_distinct([array_to_string(ws[i : i + 3], ' ') for i in range(1, len(ws) - 2)]) end as shingles from w
), n as (
  select doc_id, len(shingles)::bigint as n_shingles from s
), x as (
  select doc_id, unnest(shingles) as sh from s
), link as (
  select a.doc_id as a, b.doc_id as b from x a join x b on a.sh = b.sh and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id
  having 100 * count(*) >= 80 * ((select n_shingles from n where doc_id = a.doc_id) + (select n_shingles from n where doc_id = b.doc_id) - count(*))
), reach(a, b) as (
  select doc_id, doc_id from documents union select r.a, l.b from reach r join link l on l.a = r.b
)
select n.doc_id, n.n_shingles, min(r.b) as component_id, n.doc_id = min(r.b) as kept
from n join reach r on r.a = n.doc_id group by n.doc_id, n.n_shingles""",
}
