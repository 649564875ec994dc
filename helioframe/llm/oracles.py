"""SQL for DuckDB that gives the rows of some operators' queries by plain means: all windows, all pairs, all shingles."""

from __future__ import annotations

from helioframe.llm import decontaminate, rules, simhash, suffixes

#: Constants of XXH64. Fixed values.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_64 = "18446744073709551616::UHUGEINT"


def _n(value: int) -> str:
    return f"{value % (1 << 64)}::UHUGEINT"


def _mul(x: str, by: int) -> str:
    return f"(({x}) * {_n(by)}) % {_64}"


def _add(x: str, by: str) -> str:
    return f"(({x}) + ({by})) % {_64}"


def _turn(x: str, bits: int) -> str:
    """x is written twice, so it should be short."""
    return f"((({x}) * {_n(1 << bits)}) % {_64} + (({x}) // {_n(1 << (64 - bits))}))"


def _let(value: str, body) -> str:
    """body of a name that stands for the value, which is then computed once."""
    return f"list_transform([{value}], lambda _v: {body('_v')})[1]"


def _round(acc: str, lane: str) -> str:
    return _mul(_let(_add(acc, _mul(lane, P2)), lambda v: _turn(v, 31)), P1)


def _word(x: str, at: str, size: int) -> str:
    """The little-endian number of `size` bytes that start at byte `at` of a text of hexadecimal digits."""
    digits = " || ".join(f"substr({x}, 2 * ({at}) + {2 * i + 1}, 2)" for i in reversed(range(size)))
    return f"CAST('0x' || {digits} AS UBIGINT)::UHUGEINT"


def _mixed(h: str) -> str:
    """The last steps; h is the name of a column."""
    shift = lambda v, b: f"xor({v}::UHUGEINT, ({v} // {_n(1 << b)})::UHUGEINT)"
    one = _let(shift(h, 33), lambda v: _mul(v, P2))
    two = _let(one, lambda v: _mul(shift(v, 29), P3))
    return _let(two, lambda v: shift(v, 32))


def xxh64(source: str, name: str, seed: int) -> str:
    """CTEs that end in `name` (s, h): the hash of every distinct text s of `source` (s), as UBIGINT."""
    lanes = [_add(_n(seed), _n(P1 + P2)), _add(_n(seed), _n(P2)), _n(seed), _n(seed - P1)]
    lane = lambda i: f"list_reduce(list_transform(range(0, n // 32), lambda _k: {_word('x', f'32 * _k + {8 * i}', 8)}), lambda _a, _x: {_round('_a', '_x')}, {lanes[i]})"
    merged = "q"
    for i in range(4):
        merged = _add(_mul(f"xor(({merged})::UHUGEINT, ({_round('0::UHUGEINT', f'l{i}')})::UHUGEINT)", P1), _n(P4))
    eight = _add(_mul(_let(f"xor(_a::UHUGEINT, ({_round('0::UHUGEINT', '_x')})::UHUGEINT)", lambda v: _turn(v, 27)), P1), _n(P4))
    four = _add(_mul(_let(f"xor(_a::UHUGEINT, ({_mul('_x', P1)})::UHUGEINT)", lambda v: _turn(v, 23)), P2), _n(P3))
    one = _mul(_let(f"xor(_a::UHUGEINT, ({_mul('_x', P5)})::UHUGEINT)", lambda v: _turn(v, 11)), P1)
    return f"""
{name}_a AS (SELECT DISTINCT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n FROM {source}),
{name}_b AS (SELECT *, {", ".join(f"CASE WHEN n >= 32 THEN {lane(i)} END AS l{i}" for i in range(4))} FROM {name}_a),
{name}_c AS (SELECT *, ({_turn("l0", 1)} + {_turn("l1", 7)} + {_turn("l2", 12)} + {_turn("l3", 18)}) % {_64} AS q FROM {name}_b),
{name}_d AS (SELECT s, x, n, {_add(f"CASE WHEN n >= 32 THEN {merged} ELSE {_add(_n(seed), _n(P5))} END", "n::UHUGEINT")} AS h FROM {name}_c),
{name}_e AS (SELECT s, x, n, list_reduce(list_transform(range(n // 32 * 32, n // 8 * 8, 8), lambda _k: {_word("x", "_k", 8)}), lambda _a, _x: {eight}, h) AS h FROM {name}_d),
{name}_f AS (SELECT s, x, n, CASE WHEN n % 8 >= 4 THEN list_reduce([{_word("x", "n // 8 * 8", 4)}], lambda _a, _x: {four}, h) ELSE h END AS h FROM {name}_e),
{name}_g AS (SELECT s, list_reduce(list_transform(range(n // 4 * 4, n), lambda _k: {_word("x", "_k", 1)}), lambda _a, _x: {one}, h) AS h FROM {name}_f),
{name} AS (SELECT s, CAST({_mixed("h")} AS UBIGINT) AS h FROM {name}_g)"""


def xxh64_long(value: str, seed: str) -> str:
    """The hash of an eight-byte number, both UHUGEINT."""
    start = f"xor(({_add(seed, _n(P5 + 8))})::UHUGEINT, ({_round('0::UHUGEINT', value)})::UHUGEINT)"
    return _let(_add(_mul(_let(start, lambda v: _turn(v, 27)), P1), _n(P4)), _mixed)


WORDS = r"'[^\x20\x09-\x0D]+'"

N, BLOCK = suffixes.LENGTH, 1000
SUFFIXES = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, k * {BLOCK} AS base, substr(x, 2 * {BLOCK} * k + 1, 2 * ({BLOCK} + {N} - 1)) AS y FROM (SELECT doc_id, x, unnest(range(CAST(len(x) // (2 * {BLOCK}) AS BIGINT) + 1)) AS k FROM d)),
w AS (SELECT doc_id, base + i AS p, substr(y, 2 * i + 1, 2 * {N}) AS s FROM (SELECT doc_id, base, y, unnest(range(greatest(0, least({BLOCK}, CAST(len(y) // 2 AS BIGINT) - {N} + 1)))) AS i FROM b)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
h AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM w JOIN m USING (s) WHERE least < doc_id),
r AS (SELECT doc_id, min(p) AS a, max(p) + {N} AS z FROM (SELECT doc_id, p, sum(CASE WHEN gap <= {N} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM h) GROUP BY doc_id, run),
g AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT g.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS kept FROM g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

K, FLOOR = decontaminate.SHINGLE, decontaminate.SIMILARITY
DECONTAMINATE = rf"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least({K}, len(w)) AS k, len(w) - least({K}, len(w)) + 1 AS m FROM iw WHERE len(w) > 0),
ish AS (SELECT item_id, k, m, array_to_string(w[j + 1 : j + k], ' ') AS h, count(*) AS ci FROM (SELECT *, unnest(range(m)) AS j FROM i) GROUP BY ALL),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
dk AS (SELECT doc_id, w, k, len(w) - k + 1 AS n FROM dw CROSS JOIN (SELECT DISTINCT k FROM i) WHERE len(w) >= k),
dsh AS (SELECT doc_id, k, n, j AS pos, array_to_string(w[j + 1 : j + k], ' ') AS h FROM (SELECT *, unnest(range(n)) AS j FROM dk)),
hit AS (SELECT doc_id, item_id, m, ci, n, least(m, n) AS l, pos, d.h FROM dsh d JOIN ish s ON s.k = d.k AND s.h = d.h),
st AS (SELECT doc_id, item_id, m, ci, l, h, unnest(range(greatest(0, pos - l + 1), least(pos, n - l) + 1)) AS start FROM hit),
c AS (SELECT doc_id, item_id, m, l, start, h, least(count(*), any_value(ci)) AS common FROM st GROUP BY doc_id, item_id, m, l, start, h),
s AS (SELECT doc_id, item_id, start, CAST(sum(common) AS DOUBLE) / CAST(any_value(l) + any_value(m) - sum(common) AS DOUBLE) AS similarity FROM c GROUP BY doc_id, item_id, start)
SELECT doc_id, item_id, similarity, CAST(start AS INTEGER) AS start FROM s WHERE similarity >= {FLOOR} QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""

G = simhash.SHINGLE
SIMHASH = f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w[j + 1 : j + {G}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - {G - 1}))) AS j FROM t WHERE len(w) > 0)),
{xxh64("g", "x", simhash.SEED)},
c AS (SELECT doc_id, count(*) AS n, {", ".join(f"sum((h // {1 << b}::UBIGINT) % 2) AS b{b}" for b in range(64))} FROM g JOIN x USING (s) GROUP BY doc_id),
f AS (SELECT t.doc_id, CAST(coalesce({" + ".join(f"CASE WHEN 2 * b{b} > n THEN {1 << b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64))}, 0) AS UBIGINT) AS fp FROM t LEFT JOIN c ON c.doc_id = t.doc_id),
u AS (SELECT fp, min(doc_id) AS node FROM f GROUP BY fp),
e AS (SELECT a.node AS a, b.node AS b FROM u a JOIN u b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= {simhash.RADIUS}),
r AS (SELECT node AS a, node AS b FROM u UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a AS node, min(b) AS component_id FROM r GROUP BY a)
SELECT f.doc_id, lower(lpad(hex(f.fp), 16, '0')) AS fingerprint, m.component_id FROM f JOIN u ON u.fp = f.fp JOIN m ON m.node = u.node
"""

B = rules.BUCKETS
_PMOD = f"CAST(h % {B} AS INTEGER)"  # of the 64 bits as they are: BUCKETS is a power of two
RULES = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w, regexp_extract_all(coalesce(text, ''), '\p{{L}}+|[^\p{{L}}\x20\x09-\x0D]+') AS k FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, {WORDS}) GROUP BY doc_id),
g AS (SELECT doc_id, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS g FROM (SELECT doc_id, w, unnest(range(greatest(0, len(w) - 2))) AS p FROM t)),
o AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
v AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS place FROM o) GROUP BY doc_id),
k AS (SELECT doc_id, p, unnest(k) AS s FROM (SELECT doc_id, k, 0 AS p FROM t)),
{xxh64("k", "x", 42)},
a AS (SELECT doc_id, unnest(range(len(k))) AS p, unnest(k) AS s FROM t),
h AS (SELECT doc_id, p, x.h, lead(x.h) OVER (PARTITION BY doc_id ORDER BY p) AS next FROM a JOIN x USING (s)),
q AS (SELECT DISTINCT h, next FROM h WHERE next IS NOT NULL),
qh AS (SELECT h, next, {xxh64_long("next::UHUGEINT", xxh64_long("h::UHUGEINT", _n(42)))} AS pair FROM q),
n AS (SELECT doc_id, {_PMOD} AS b FROM h UNION ALL SELECT h.doc_id, CAST(pair % {B} AS INTEGER) FROM h JOIN qh ON qh.h = h.h AND qh.next = h.next),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
c AS (SELECT b, count(*) + 1 AS raw, count(good.doc_id) + 1 AS target FROM n LEFT JOIN good ON good.doc_id = n.doc_id GROUP BY b),
z AS (SELECT (SELECT sum(raw) FROM c) + {B} - (SELECT count(*) FROM c) AS raw, (SELECT sum(target) FROM c) + {B} - (SELECT count(*) FROM c) AS target),
ratio AS (SELECT b, CASE WHEN z.target = {B} THEN 0 ELSE ln(c.target) - ln(c.raw) + ln(z.raw) - ln(z.target) END AS r FROM c, z),
s AS (SELECT doc_id, avg(r) AS score FROM n JOIN ratio ON ratio.b = n.b GROUP BY doc_id),
m AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(score, 0) AS score
  FROM t LEFT JOIN l ON l.doc_id = t.doc_id LEFT JOIN v ON v.doc_id = t.doc_id LEFT JOIN s ON s.doc_id = t.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND score >= {rules.THRESHOLD} AS kept, round(score, 6) + 0.0::DOUBLE AS score FROM m
"""

ORACLE_SQL = {"op2_suffixes": SUFFIXES, "op7_rules": RULES, "op9_decontaminate": DECONTAMINATE, "op10_simhash": SIMHASH}
