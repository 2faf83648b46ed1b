"""Queries of this subpackage by name, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from .collocations import op12_phrase_collocations
from .embedding_dedup import op5_embedding_near_dedup
from .language_id import op3_language_id
from .lm import op7_lm_scoring
from .merkle import op11_merkle_manifest
from .mixing import op6_source_mixing
from .packing import op2_best_fit_packing
from .quality_classifier import op8_quality_classifier
from .quality_rules import op9_quality_rules
from .simhash import op4_simhash_near_dedup
from .suffix_dedup import op1_suffix_array_dedup
from .token_files import op13_token_files
from .warc import op10_warc_revisits

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc_revisits": op10_warc_revisits,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_token_files": op13_token_files,
}
#: Bits of the hex digest, five by five, are the letters of base32.
_BITS = "array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', substr(hexed, i, 1)) - 1), 4, '0')), '')"
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda k: (substr(bits, j * 5 + k + 1, 1) = '1')::int * (1 << (4 - k)))))::int, 1)), '')".replace(")))))::int, 1)", "))))::int, 1)")

_USABLE = "label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
_COSINE = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"



def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::varchar) || ':' || ({value})::varchar, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Unsigned crc32 of a number's decimals, bit by bit.
_CRC32 = "xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::ubigint), lambda h, c: list_reduce([xor(h, c), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, i: xor(x >> 1, (x & 1) * 3988292384::ubigint)::ubigint), 4294967295::ubigint), 4294967295::ubigint)"
_SIDES = "coalesce(array_to_string(list_slice(u.kids, 1, p.idx % 3), ''), '') as l, coalesce(array_to_string(list_slice(u.kids, p.idx % 3 + 2, 3), ''), '') as r"


def _climb(name: str, start: str, tree: str) -> str:
    """A recursive table of nodes: level, tree, idx, n, digest, kids."""
    return f"{name} as ({start} union all select level + 1, {tree}, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' order by idx)), list(digest order by idx) from {name} where n > 1 group by level, {tree}, idx // 3, n)"


def _walk(name: str, start: str, nodes: str, tree: str, keys: str) -> str:
    """A recursive table of leaves on their way up: keys, tree, level, idx, n, siblings so far, and the digest that the tampered leaf gives."""
    step = f"select p.*, u.n as un, {_SIDES} from {name} p join {nodes} u on u.level = p.level + 1 and u.{tree} is not distinct from p.{tree} and u.idx = p.idx // 3 where p.n > 1"
    return f"{name} as ({start} union all select {keys}, {tree}, level + 1, idx // 3, un, seen || l || r, sha256(l || folded || r) from ({step}))"


_MERKLE = f"""with recursive leaves as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by source) as n, row_number() over () as row
    from (select doc_id, source, {_leaf("text")} as leaf, case when {_CRC32} % 2 = 0 then {_leaf("replace(text, chr(10), '')")} else {_leaf("text")} end as tampered from documents)),
  {_climb("up", "select 0 as level, source, idx, n, leaf as digest, null::varchar[] as kids from leaves", "source")},
  subroots as (select source, digest, row_number() over (order by source nulls first) - 1 as idx, count(*) over () as n, 0 as tree from up where n = 1),
  {_climb("top", "select 0 as level, tree, idx, n, digest, null::varchar[] as kids from subroots", "tree")},
  {_walk("walk", "select row, source, 0 as level, idx, n, '' as seen, tampered as folded from leaves", "up", "source", "row")},
  {_walk("over_all", "select w.row, s.tree, 0 as level, s.idx, s.n, w.seen, w.folded from walk w join subroots s on s.source is not distinct from w.source where w.n = 1", "top", "tree", "row")}
  select d.doc_id, d.leaf, s.digest as subroot, t.digest as root, sha256(o.seen) as proof_sha256, o.folded as folded_root, o.folded = t.digest as verified
  from leaves d join subroots s on s.source is not distinct from d.source join over_all o on o.row = d.row and o.n = 1 cross join (select digest from top where n = 1) t"""

_CUT = "array_to_string(list_slice(w, {}, {}), ' ')"
_COLLOCATIONS = f"""with pieces as (select lang, row_number() over () as p, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
  grams as (select lang, k, {_CUT.format("i", "i + k - 1")} as phrase from (select *, unnest(range(1, len(w) - k + 2)) as i from pieces, (select unnest(range(1, 6)) as k) where len(w) >= k)),
  counts as (select lang, k, phrase, count(*) as f from grams group by all having count(*) >= 100),
  totals as (select lang, sum(len(w)) as n from pieces group by lang),
  cuts as (select c.lang, c.phrase, c.f as a, j, l.f as l, r.f as r, n, (1000::hugeint * c.f * n) // (l.f::hugeint * r.f) as score
    from (select *, string_split(phrase, ' ') as w, unnest(range(1, k)) as j from counts where k > 1) c join counts l on l.lang = c.lang and l.phrase = {_CUT.format(1, "j")} join counts r on r.lang = c.lang and r.phrase = {_CUT.format("j + 1", "c.k")} join totals t on t.lang = c.lang),
  lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
  held as (select lang, {_CUT.format("i", "i + s - 1")} as phrase, max(f) as longer from (select *, unnest(range(1, k - s + 2)) as i from (select *, string_split(phrase, ' ') as w, unnest(range(2, k)) as s from counts where k > 2)) group by all)
  select l.lang, row_number() over (partition by l.lang order by score desc, a desc, l.phrase) as rank, l.phrase, a, l, r, n::bigint as n, score::bigint as score from lowest l left join held h on h.lang = l.lang and h.phrase = l.phrase where longer is null or 100 * longer < 100 * a qualify rank <= 2000"""

ORACLE_SQL: dict[str, str] = {
    # Bytes as pairs of hex digits; each window of 200 by its MD5.
    "op1_suffix_array_dedup": """with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
  windows as (select doc_id, i, md5(substr(h, 2 * i + 1, 400)) as k from (select doc_id, h, unnest(range(0, n - 199)) as i from docs)),
  hits as (select doc_id, i from windows where k in (select k from windows group by k having count(*) > 1)),
  islands as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as g from (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end as fresh from hits)),
  spans as (select doc_id, min(i) as a, max(i) + 200 as b from islands group by doc_id, g),
  edges as (select doc_id, a, b from spans union all select doc_id, n, n from docs),
  parts as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a, b), 0) as lo from edges)
  select d.doc_id, any_value(d.n) as n_bytes, sum(p.b - p.a)::bigint as n_removed, count(*) filter (where p.b > p.a) as n_spans, sha256(unhex(string_agg(substr(d.h, 2 * p.lo + 1, 2 * (p.a - p.lo)), '' order by p.a, p.b))) as kept_sha256
  from docs d join parts p on p.doc_id = d.doc_id group by d.doc_id""",
    "op5_embedding_near_dedup": f"""with recursive usable as (select vec_id, label, embedding::double[] as v from embeddings where {_USABLE}),
  links as (select a.vec_id as a, b.vec_id as b from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) where {_COSINE} >= 0.98),
  reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on l.a = r.b)
  select e.vec_id, coalesce(n.n, 0) as n_links, c.c as component_id, e.vec_id = c.c as kept from embeddings e join (select a, min(b) as c from reach group by a) c on c.a = e.vec_id left join (select a, count(*) as n from links group by a) n on n.a = e.vec_id""",
    "op10_warc_revisits": f"""select page_id, payload_bytes, {_BASE32} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
  from (select *, {_BITS} as bits from (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as hexed, min(page_id) over (partition by coalesce(html, '')) as first from pages))""",
    "op11_merkle_manifest": _MERKLE,
    "op12_phrase_collocations": _COLLOCATIONS,
}
