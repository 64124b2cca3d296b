"""DuckDB SQL for the contract queries that SQL can express. The others are held against brute force in the tests."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32(text: str) -> str:
    """crc32 of a text of digits, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    bytes_ = f"list_transform(list_filter(string_split({text}, ''), lambda s: s <> ''), lambda s: ascii(s)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bytes_}), lambda c, b: {step}), 4294967295::bigint)"


OP2 = rf"""with recursive d as (select doc_id, {_WORDS.format(_LOWER)} w from documents),
 s as (select distinct doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') g from (select doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) i from d where len(w) > 0)),
 n as (select doc_id, count(*) n from s group by doc_id),
 p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
 l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
 u as (select x, y from l union select y, x from l),
 r as (select doc_id, doc_id reach from documents union select r.doc_id, u.y from r join u on u.x = r.reach)
 select doc_id, coalesce(max(n.n), 0)::bigint n_shingles, min(reach) component_id, doc_id = min(reach) kept from r left join n using (doc_id) group by doc_id"""

OP7 = rf"""with d as (select doc_id, text, source, len({_WORDS.format("coalesce(text, '')")})::bigint size from documents),
 s as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) rn from d group by source),
 w as (select source, source_size, 3 * source_size cap, [5, 2, 1][(rn - 1) % 3 + 1] weight from s),
 v as (select *, (sum(source_size) over () - coalesce(sum(cap) over f, 0))::double / (sum(weight) over () - coalesce(sum(weight) over f, 0))::double lvl
  from w window f as (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding)),
 t as (select source, source_size, least(cap::double, max(lvl) over () * weight) target from v),
 j as (select doc_id, text, size, source_size, target, case when source_size > 0 then target / source_size else 0 end rate from d join t on d.source is not distinct from t.source)
 select doc_id, size, source_size, target, size * (floor(rate)::bigint + (('0x' || substr(md5('7|' || coalesce(doc_id::varchar, '') || '|' || coalesce(text, '') || '|'), 1, 8))::bigint / 4294967296.0::double < rate - floor(rate))::bigint) taken from j"""

def _op9(order: int) -> str:
    """Each token with its contexts; per order, counts of n-grams and contexts, and the escape of each class of contexts."""
    ks = range(1, order)
    contexts = ", ".join(f"case when i >= {k} then array_to_string(w[i - {k} + 1 : i], ' ') end h{k}" for k in ks)
    tables = "".join(f""", g{k} as (select h{k} h, t, count(*) c from p where not held_out and h{k} is not null group by h{k}, t),
 s{k} as (select h, sum(c)::bigint s, case when sum(c) <= 1 then 0 else length(bin(sum(c)::bigint - 1)) end kind from g{k} group by h),
 e{k} as (select kind, (coalesce(sum(c) filter (where c = 1), 0) + 1)::double / (sum(c) + 2) e from g{k} join s{k} using (h) group by kind)""" for k in ks)  # fmt: skip
    joins = "".join(f" left join s{k} on s{k}.h = p.h{k} left join g{k} on g{k}.h = p.h{k} and g{k}.t = p.t left join e{k} on e{k}.kind = s{k}.kind" for k in ks)
    steps = "".join(f", case when s{k}.s is null then p{k - 1} else (1 - e{k}.e) * coalesce(g{k}.c, 0) / s{k}.s + e{k}.e * p{k - 1} end p{k}" for k in ks)
    return rf"""with d as (select doc_id, {_crc32("coalesce(doc_id::varchar, '')")} % 7 = 2 held_out, list_concat(list_concat([' s'], {_WORDS.format(_LOWER)}), [' e']) w from documents),
 p as (select doc_id, held_out, w[i + 1] t, {contexts} from (select *, unnest(range(1, len(w))) i from d)),
 c1 as (select t, count(*) c from p where not held_out group by t),
 k as (select sum(c)::bigint n, count(*) v from c1){tables},
 q as (select doc_id, held_out, coalesce(c1.c, 0) c0, (coalesce(c1.c, 0) + 1)::double / (n + v + 1) p0, n{steps}
  from p cross join k left join c1 on c1.t = p.t{joins})
 select doc_id, held_out, count(*) n_tokens, count(*) filter (where c0 > 0) n_known, max(n) train_tokens, round(sum(log10(p0)), 6) base_score,
  round(sum(log10(p{order - 1})), 6) score from q group by doc_id, held_out"""


OP9 = _op9(3)


_CLASSES = ("a-z", "A-Z", "0-9", r"\x20\x09-\x0D", r".,;:!?''\"()\-", "#*$%&|<>", r"\x{80}-\x{10FFFF}")
_COUNTS = ", ".join(f"length(regexp_replace(t, '[^{c}]', '', 'g')) k{i}" for i, c in enumerate(_CLASSES))
_HALVES = "(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end)"

#: Base counts; per language the references of classes and of common words; both distances to the nearest one held against.
OP6 = rf"""with d as (select doc_id, lang, coalesce(text, '') t, {_WORDS.format("coalesce(text, '')")} w from documents),
 grams as (select doc_id, i, array_to_string(w[i : i + 2], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from d where len(w) > 2)),
 again as (select doc_id, count(distinct i + k) n from grams semi join (select doc_id, g from grams group by doc_id, g having count(*) > 1) using (doc_id, g), (values (0), (1), (2)) v(k) group by doc_id),
 lines as (select doc_id, count(*) - count(distinct l) n from (select doc_id, unnest(string_split(t, chr(10))) l from d) where regexp_matches(l, '[^ 	-
]') group by doc_id),
 m as (select d.*, len(w) n_words, coalesce(again.n, 0) n_repeat_words, coalesce(lines.n, 0) n_dup_lines, length(t) n_chars, {_COUNTS} from d left join again using (doc_id) left join lines using (doc_id)),
 f as (select *, n_chars - k0 - k1 - k2 - k3 - k4 - k5 - k6 k7, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m),
 words as (select doc_id, lang, base_failed, unnest(w) x from f),
 refs as (select lang ref, sum(n_words) total, sum(n_words) filter (not base_failed) passing, {", ".join(f"sum(k{i}) filter (not base_failed) r{i}" for i in range(8))}
  from f where lang is not null group by lang having coalesce(sum(n_words) filter (not base_failed), 0) >= 1000),
 common as (select ref, x, count(*) filter (not base_failed) n from words join refs on ref = lang group by ref, x, total having count(*) >= total / 400.0::double),
 bins as (select ref, x, n::double / passing q from common join refs using (ref) union all select ref, null, (passing - coalesce((select sum(n) from common c where c.ref = refs.ref), 0))::double / passing from refs),
 pairs as (select doc_id, ref, n_words from f join refs on lang = ref union all select doc_id, ref, n_words from f, refs where lang is null or lang not in (select ref from refs)),
 own as (select doc_id, pairs.ref, c.x, count(*)::double / any_value(n_words) p from pairs join words using (doc_id) left join common c on c.ref = pairs.ref and c.x = words.x group by doc_id, pairs.ref, c.x),
 word_far as (select doc_id, own.ref, sqrt(greatest(0, (sum({_HALVES}) + 1 - sum(q)) / 2)) far from own join bins on bins.ref = own.ref and bins.x is not distinct from own.x group by doc_id, own.ref),
 spread as (select doc_id, ref, unnest([{", ".join(f"k{i}" for i in range(8))}])::double / n_chars p, unnest([{", ".join(f"r{i}" for i in range(8))}])::double / (r0+r1+r2+r3+r4+r5+r6+r7) q from pairs join f using (doc_id) join refs using (ref) where n_chars > 0 and f.n_words > 0),
 char_far as (select doc_id, ref, sqrt(greatest(0, sum({_HALVES}) / 2)) far from spread group by doc_id, ref),
 near as (select doc_id, round(case when n_chars >= 200 then (select min(far) from char_far c where c.doc_id = f.doc_id) end, 9) char_distance,
  round(case when n_words >= 50 then (select min(far) from word_far c where c.doc_id = f.doc_id) end, 9) word_distance from f)
 select doc_id, n_words, n_chars - k3 word_chars, k5 n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance,
  not base_failed and coalesce(char_distance, 0) <= 0.31 and coalesce(word_distance, 0) <= 0.45 kept from f join near using (doc_id)"""


def _op4(length: int) -> str:
    """All pairs by brute force, the products added in the order of the components. The index finds all of these where its
    windows cover the table, as they do on the smallest ones; on larger ones its recall is measured instead."""
    score = " + ".join(f"q.v[{i}] * e.v[{i}]" for i in range(1, length + 1))
    finite = "len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0"
    return f"""with e as (select vec_id, v from (select vec_id, embedding::double[] v from embeddings) where vec_id is not null and len(v) = {length} and {finite}),
 s as (select q.vec_id query_id, e.vec_id, {score} score from e q join e on e.vec_id <> q.vec_id where q.vec_id % 20 = 0),
 r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s) select * from r where rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": OP2, "op4_hilbert_neighbours": _op4(64), "op6_quality_rules": OP6, "op7_mixing": OP7, "op9_lm_scoring": OP9}
