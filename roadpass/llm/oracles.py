"""DuckDB SQL for those queries of this subpackage that SQL expresses over whole tables."""

from __future__ import annotations

import string

from roadpass.llm.importance import BUCKETS, SEED
from roadpass.llm.line_dedup import CONSTANT, LEADING, MIN_DOCS, SPACE, WORD
from roadpass.llm.manifest import FIELDS

LINE_DEDUP = rf"""
with whole as (select distinct text from documents where text is not null),
keyed as (select row_number() over () k, text, string_split(text, chr(10)) parts from whole),
places as (select k, unnest(parts) line, generate_subscripts(parts, 1) - 1 n from keyed),
flat as (select k, n, regexp_replace(line, '{WORD}*[0-9]{WORD}*', '<*>', 'g') line from places),
led as (
  select *, regexp_extract(line, '^{SPACE}*((?:{WORD}+{SPACE}+){{0,{LEADING - 1}}}{WORD}+)', 1) lead,
    list_filter(regexp_split_to_array(line, '{SPACE}+'), lambda t: t <> '') tokens
  from flat
),
keys as (select k, n, line, tokens, [len(tokens)::varchar, lead] leaf from led where lead <> ''),
leaves as (select leaf from keys group by leaf having count(distinct k) >= {MIN_DOCS}),
crowded as (select * from keys semi join leaves using (leaf)),
variants as (select leaf, line, any_value(tokens) tokens, count(distinct k) docs from crowded group by leaf, line),
tokens as (select leaf, line, docs, unnest(tokens) token, generate_subscripts(tokens, 1) pos from variants),
support as (
  select leaf, pos, token from tokens where token <> '<*>' group by leaf, pos, token having sum(docs) >= {MIN_DOCS}
),
fixed as (
  select leaf, line, list([pos::varchar, token] order by pos) template, count(*) constants
  from tokens join support using (leaf, pos, token) group by leaf, line
),
templates as (
  select leaf, line, template from fixed join variants using (leaf, line) where constants >= {CONSTANT} * len(tokens)
),
placed as (select k, n, leaf, template from crowded join templates using (leaf, line)),
recurring as (select leaf, template from placed group by leaf, template having count(distinct k) >= {MIN_DOCS}),
gone as (select k, list(distinct n) gone from placed semi join recurring using (leaf, template) group by k),
cut as (select text, parts, coalesce(gone, []) gone from keyed left join gone using (k))
select doc_id, coalesce(len(parts), 0)::bigint n_lines, coalesce(len(gone), 0)::bigint n_dropped,
  sha256(array_to_string(list_filter(parts, lambda x, i: not list_contains(gone, i - 1)), chr(10))) kept_sha256
from documents left join cut using (text)
"""


_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase

# CRC-32 byte by byte, over a table of one row.
_CRC_TABLE = """
crc_table as (
  select list(c order by i) t from (
    select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) c
    from range(256) r(i)
  )
)
"""


def _crc(text: str) -> str:
    number = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce({number}, lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295), 4294967295)"


IMPORTANCE = rf"""
with {_CRC_TABLE},
docs as (
  select row_number() over () k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws
  from documents
),
target as (
  select regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark
),
doc_words as (select k, w, count(*) n from (select k, unnest(ws) w from docs) group by k, w),
target_words as (select w, count(*) n from (select unnest(ws) w from target) group by w),
words as (select distinct w from (select w from doc_words union all select w from target_words)),
bucketed as (select w, {_crc("w")} % {BUCKETS} b from words, crc_table),
s as (select b, sum(n) n from doc_words join bucketed using (w) group by b),
t as (select b, sum(n) n from target_words join bucketed using (w) group by b),
totals as (select (select coalesce(sum(n), 0) from s) s_all, (select coalesce(sum(n), 0) from t) t_all),
gains as (
  select b, floor(1000 * ln((coalesce(t.n, 0) + 1.0)::double * (s_all + {BUCKETS})::double
    / ((coalesce(s.n, 0) + 1.0)::double * (t_all + {BUCKETS})::double)))::bigint gain
  from range({BUCKETS}) r(b) left join s using (b) left join t using (b), totals
),
weights as (select k, sum(n * gain)::bigint weight from doc_words join bucketed using (w) join gains using (b) group by k),
weighed as (
  select doc_id, len(ws) n_features, coalesce(weight, 0) weight,
    ('0x' || left(sha256('{SEED}:' || doc_id), 8))::ubigint::double h
  from docs left join weights using (k)
),
scored as (
  select doc_id, n_features::bigint n_features, weight,
    weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint score
  from weighed
),
ranked as (
  select *, row_number() over (order by score desc, doc_id) place, count(*) over () able from scored where n_features >= 20
)
select doc_id, n_features, weight, score, case when place <= 10 * able // 100 then place end rank from ranked
union all
select doc_id, n_features, weight, score, null from scored where n_features < 20
"""

URL_FILTER = rf"""
with rules(rule_host, rule_path, verdict) as (values
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')
),
cut as (
  select row_number() over () k, page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end rest
  from pages
),
named as (
  select k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path
  from cut
),
fitting as (
  select k, rule_host || rule_path rule, verdict, row_number() over (partition by k order by length(rule_host || rule_path) desc) i
  from named join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict
from named left join (select * from fitting where i = 1) using (k)
"""


def _leaf(text: str) -> str:
    fields = [text if f == "text" else f"{f}::varchar" for f in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + ")"


# Trees first, then for every leaf the siblings and the folded digest, level by level.
MANIFEST = rf"""
with recursive {_CRC_TABLE.strip()},
rows as (
  select doc_id, lang, {_leaf("text")} leaf, {_crc("doc_id::varchar")} % 3 = 0 altered,
    {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} other
  from documents, crc_table
),
groups as (select lang, row_number() over (order by lang nulls first) - 1 g, count(*) n from rows group by lang),
leaves as (
  select doc_id, g, n, leaf, case when altered then other else leaf end folded,
    row_number() over (partition by g order by doc_id) - 1 pos
  from rows join groups on rows.lang is not distinct from groups.lang
),
low(g, lvl, n, pos, d) as (
  select g, 0, n, pos, leaf from leaves
  union all
  select g, lvl + 1, (n + 7) // 8, pos // 8, sha256(string_agg(d, '' order by pos)) from low where n > 1 group by g, lvl, n, pos // 8
),
subroots as (select g, d from low where n = 1),
high(lvl, n, pos, d) as (
  select 0, (select count(*) from subroots), g, d from subroots
  union all
  select lvl + 1, (n + 7) // 8, pos // 8, sha256(string_agg(d, '' order by pos)) from high where n > 1 group by lvl, n, pos // 8
),
low_beside as (
  select a.g, a.lvl, a.pos, coalesce(string_agg(b.d, '' order by b.pos) filter (b.pos < a.pos), '') l,
    coalesce(string_agg(b.d, '' order by b.pos) filter (b.pos > a.pos), '') r
  from low a join low b on a.g = b.g and a.lvl = b.lvl and a.pos // 8 = b.pos // 8 where a.n > 1 group by a.g, a.lvl, a.pos
),
high_beside as (
  select a.lvl, a.pos, coalesce(string_agg(b.d, '' order by b.pos) filter (b.pos < a.pos), '') l,
    coalesce(string_agg(b.d, '' order by b.pos) filter (b.pos > a.pos), '') r
  from high a join high b on a.lvl = b.lvl and a.pos // 8 = b.pos // 8 where a.n > 1 group by a.lvl, a.pos
),
low_up(doc_id, g, lvl, n, pos, proof, d) as (
  select doc_id, g, 0, n, pos, '', folded from leaves
  union all
  select u.doc_id, u.g, u.lvl + 1, (u.n + 7) // 8, u.pos // 8, u.proof || b.l || b.r, sha256(b.l || u.d || b.r)
  from low_up u join low_beside b on u.g = b.g and u.lvl = b.lvl and u.pos = b.pos
),
high_up(doc_id, g, lvl, n, pos, proof, d) as (
  select doc_id, g, 0, (select count(*) from subroots), g, proof, d from low_up where n = 1
  union all
  select u.doc_id, u.g, u.lvl + 1, (u.n + 7) // 8, u.pos // 8, u.proof || b.l || b.r, sha256(b.l || u.d || b.r)
  from high_up u join high_beside b on u.lvl = b.lvl and u.pos = b.pos
)
select leaves.doc_id, leaf, subroots.d subroot, high.d root, sha256(proof) proof_sha256, u.d folded_root, u.d = high.d verified
from leaves join subroots using (g) join high_up u using (doc_id) join high on high.n = 1
where u.n = 1
"""


def sql() -> dict[str, str]:
    return {
        "op5_log_template_line_dedup": LINE_DEDUP,
        "op11_importance_resampling": IMPORTANCE,
        "op12_url_filter_cascade": URL_FILTER,
        "op13_merkle_manifest": MANIFEST,
    }
