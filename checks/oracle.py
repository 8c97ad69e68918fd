"""The same results in DuckDB SQL, written from the definitions and not from the Spark plans."""

from __future__ import annotations

ATTRS = ("brand", "name")
ALL = "allattr"
STATS = ("mean", "sum", "count", "min", "max", "M-m", "median")
# names of the definition: per attribute and side 4 blocks, then 17 blocks over all attributes
BLOCKS = {f"{side}_{a}": ("paired", "unpaired", "perc", "diff") for side in ("left", "right") for a in ATTRS} | {ALL: (
    "all", "paired", "unpaired", "unpaired_both", "unpaired_exclusive", "unpaired_min", "unpaired_max",
    "perc_exclusive", "diff_exclusive", "perc", "diff", "perc_both", "diff_both", "perc_min", "diff_min", "perc_max", "diff_max")}
NAMES = [f"{s}_{block}_{scope}" for scope, blocks in BLOCKS.items() for block in blocks for s in STATS]
COEF = {n: ((i * 37) % 11 - 5) / 10 for i, n in enumerate(NAMES)}
WS = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

# ---- inputs ---------------------------------------------------------------------------------------

PAIRS = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS rn FROM part),
pairs AS (
  SELECT l.p_partkey * 8 + (r.rn - l.rn) AS id, l.p_partkey AS left_id, r.p_partkey AS right_id,
         CASE WHEN l.p_name = r.p_name THEN 1 ELSE 0 END AS label,
         l.p_brand AS left_brand, l.p_name AS left_name, r.p_brand AS right_brand, r.p_name AS right_name
  FROM ranked l JOIN ranked r ON l.p_type = r.p_type AND r.rn BETWEEN l.rn + 1 AND l.rn + 5),
gaps AS (SELECT id, left_id, right_id, label, CASE WHEN label = 0 THEN left_brand END AS left_brand, left_name,
                right_brand, right_name FROM pairs)"""


def words(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col}, '{WS}'), lambda x: x <> '')"


def _ascii(col: str) -> str:
    return f"lower(regexp_replace({col}, '[^\\x00-\\x7F]', '', 'g'))"


def _tok(source: str, key: str, cols: list[tuple[str, str, str]]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {key}, '{side}' AS side, '{attr}' AS attr, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS attr_pos "
        f"FROM (SELECT {key}, {words(_ascii(col))} AS ws FROM {source})" for side, attr, col in cols)
    return (f"(SELECT {key}, side, attr, attr_pos::INT AS attr_pos, word, "
            f"(row_number() OVER (PARTITION BY {key}, side ORDER BY attr, attr_pos) - 1)::INT AS pos FROM ({parts}))")


TOKENS = PAIRS + ",\ntok AS " + _tok("pairs", "id", [
    ("left", "brand", "left_brand"), ("left", "name", "left_name"),
    ("right", "brand", "right_brand"), ("right", "name", "right_name")]) + """,
lt AS (SELECT id, pos AS l, attr AS la, word AS lw FROM tok WHERE side = 'left'),
rt AS (SELECT id, pos AS r, attr AS ra, word AS rw FROM tok WHERE side = 'right')"""

PREFIX = "CASE " + " ".join(
    f"WHEN length(lw) >= {k} AND length(rw) >= {k} AND left(lw, {k}) = left(rw, {k}) THEN {k}" for k in (4, 3, 2, 1)) + " ELSE 0 END"
GRID = f""",
wp AS (SELECT DISTINCT lw, rw FROM lt JOIN rt USING (id)),
ws AS (SELECT lw, rw, round(j + {PREFIX} * 0.1 * (1 - j), 9) AS s FROM (SELECT lw, rw, jaro_similarity(lw, rw) AS j FROM wp)),
grid AS (SELECT lt.id, l, r, la, ra, lw, rw, s FROM lt JOIN rt USING (id) JOIN ws USING (lw, rw))"""
EDGES = TOKENS + GRID

ENTITY = ",\nptok AS " + _tok("part", "p_partkey", [("left", "brand", "p_brand"), ("left", "name", "p_name")])
VOCAB = ENTITY + """,
vocab AS (SELECT word, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM (
  SELECT word, row_number() OVER (ORDER BY md5(concat_ws('|', '0', word)), word) - 1 AS vec_id FROM (SELECT DISTINCT word FROM ptok))
  JOIN embeddings USING (vec_id))"""
VECTOR_GRID = TOKENS + VOCAB + """,
wp AS (SELECT DISTINCT lw, rw FROM lt JOIN rt USING (id)),
ws AS (SELECT lw, rw, round(list_dot_product(a.vec, b.vec) / greatest(sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)), 1e-6), 9) AS s
  FROM wp JOIN vocab a ON a.word = lw JOIN vocab b ON b.word = rw),
grid AS (SELECT lt.id, l, r, la, ra, lw, rw, s FROM lt JOIN rt USING (id) JOIN ws USING (lw, rw))"""


# ---- matching ----------------------------------------------------------------------------------------

def fold(name: str, edges: str) -> str:
    """Best edge first, one step of the recursion per edge rank."""
    hit = "list_contains(f.ls, e.l) OR list_contains(f.rs, e.r)"
    return f""",
{name}_e AS (SELECT id, l, r, row_number() OVER (PARTITION BY id ORDER BY s DESC, l, r) AS rn FROM ({edges})),
{name}_f AS (
  SELECT DISTINCT id, 0::BIGINT AS rn, []::INT[] AS ls, []::INT[] AS rs FROM {name}_e
  UNION ALL
  SELECT f.id, f.rn + 1, CASE WHEN {hit} THEN f.ls ELSE list_append(f.ls, e.l) END,
         CASE WHEN {hit} THEN f.rs ELSE list_append(f.rs, e.r) END
  FROM {name}_f f JOIN {name}_e e ON e.id = f.id AND e.rn = f.rn + 1),
{name} AS (SELECT id, unnest(ls) AS l, unnest(rs) AS r FROM (
  SELECT id, arg_max(ls, rn) AS ls, arg_max(rs, rn) AS rs FROM {name}_f GROUP BY id))"""


def schema_slots(unpair=0.60, cross=0.65, dup=0.75) -> str:
    return (
        fold("m1", f"SELECT * FROM grid WHERE la = ra AND s >= {unpair}")
        + """,
l1 AS (SELECT id, l FROM lt ANTI JOIN m1 USING (id, l)), r1 AS (SELECT id, r FROM rt ANTI JOIN m1 USING (id, r))"""
        + fold("m2", f"SELECT g.* FROM grid g SEMI JOIN l1 USING (id, l) SEMI JOIN r1 USING (id, r) WHERE s >= {cross}".replace(
            "SELECT g.* FROM grid g SEMI JOIN l1 USING (id, l) SEMI JOIN r1 USING (id, r)",
            "SELECT g.* FROM (SELECT * FROM grid SEMI JOIN l1 USING (id, l)) g SEMI JOIN r1 USING (id, r)"))
        + """,
l2 AS (SELECT id, l FROM l1 ANTI JOIN m2 USING (id, l)), r2 AS (SELECT id, r FROM r1 ANTI JOIN m2 USING (id, r))"""
        + fold("m3", f"SELECT * FROM grid SEMI JOIN r2 USING (id, r) WHERE s >= {dup}")
        + fold("m4", f"SELECT * FROM grid SEMI JOIN l2 USING (id, l) WHERE s >= {dup}")
        + """,
slots AS (
  SELECT id, 1 AS pass_no, l, r FROM m1 UNION ALL SELECT id, 2, l, r FROM m2
  UNION ALL SELECT id, 3, l, r FROM m3 UNION ALL SELECT id, 3, -1, r FROM (SELECT * FROM r2 ANTI JOIN m3 USING (id, r))
  UNION ALL SELECT id, 4, l, r FROM m4 UNION ALL SELECT id, 4, l, -1 FROM (SELECT * FROM l2 ANTI JOIN m4 USING (id, l)))"""
    )


def flat_slots(unpair=0.60, dup: float | None = 0.75) -> str:
    many = f"SELECT id, l, r FROM grid WHERE s > {dup}" if dup is not None else "SELECT id, l, r FROM grid WHERE false"
    return f""",
dm AS ({many}),
rest AS (SELECT * FROM (SELECT * FROM grid ANTI JOIN dm USING (id, l)) ANTI JOIN dm USING (id, r))""" + fold(
        "m1", f"SELECT * FROM rest WHERE s >= {unpair}") + """,
used AS (SELECT id, l, r FROM dm UNION ALL SELECT id, l, r FROM m1),
slots AS (
  SELECT id, 1 AS pass_no, l, r FROM used UNION ALL SELECT id, 1, l, -1 FROM (SELECT * FROM lt ANTI JOIN used USING (id, l))
  UNION ALL SELECT id, 1, -1, r FROM (SELECT * FROM rt ANTI JOIN used USING (id, r)))"""


UNITS_TAIL = """,
units AS (
  SELECT s.id, (row_number() OVER (PARTITION BY s.id ORDER BY pass_no, s.l, s.r) - 1)::INT AS unit_no, pass_no,
         s.l AS left_pos, s.r AS right_pos, coalesce(lt.lw, '[UNP]') AS left_word, coalesce(rt.rw, '[UNP]') AS right_word,
         coalesce(g.s, 0.0)::DOUBLE AS cos_sim, coalesce(lt.la, '[UNP]') AS left_attribute,
         coalesce(rt.ra, '[UNP]') AS right_attribute, p.label
  FROM slots s JOIN pairs p ON p.id = s.id LEFT JOIN lt ON lt.id = s.id AND lt.l = s.l
  LEFT JOIN rt ON rt.id = s.id AND rt.r = s.r LEFT JOIN grid g ON g.id = s.id AND g.l = s.l AND g.r = s.r)"""
UNITS = EDGES + schema_slots() + UNITS_TAIL
FLAT_UNITS = EDGES + flat_slots() + UNITS_TAIL
VECTOR_UNITS = VECTOR_GRID + schema_slots() + UNITS_TAIL
VIEW = ("id, unit_no, pass_no, left_pos, right_pos, left_word, right_word, cos_sim, left_attribute, right_attribute, label")
NO_NUMBER = VIEW.replace("unit_no, ", "")


def sql(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


# ---- features -------------------------------------------------------------------------------------------

def member_ctes(pred: str = "cos_sim", complementary: bool = True) -> str:
    unp = "1 - 2 * pred" if complementary else "2 * pred"
    excl = "(left_word = '[UNP]' OR right_word = '[UNP]')"
    return f""",
scored AS (SELECT *, {pred} AS pred FROM units),
marked AS (SELECT *, NOT {excl} AND pred >= 0.5 AS paired, {excl} AS exclusive FROM scored),
valued AS (SELECT *, CASE WHEN paired THEN (pred - 0.5) * 2 ELSE {unp} END AS v FROM marked),
members AS (
  SELECT id, unit_no, '{ALL}' AS scope, 'all' AS grp, pred AS v FROM valued
  UNION ALL SELECT id, unit_no, '{ALL}', CASE WHEN paired THEN 'paired' ELSE 'unpaired' END, v FROM valued
  UNION ALL SELECT id, unit_no, '{ALL}', CASE WHEN exclusive THEN 'unpaired_exclusive' ELSE 'unpaired_both' END, v FROM valued WHERE NOT paired
  UNION ALL SELECT id, unit_no, '{ALL}', CASE WHEN left_word = '[UNP]' THEN 'left' ELSE 'right' END, v FROM valued WHERE NOT paired AND exclusive
  UNION ALL SELECT id, unit_no, 'left_' || left_attribute, CASE WHEN paired THEN 'paired' ELSE 'unpaired' END, v FROM valued WHERE left_attribute IN ('brand', 'name')
  UNION ALL SELECT id, unit_no, 'right_' || right_attribute, CASE WHEN paired THEN 'paired' ELSE 'unpaired' END, v FROM valued WHERE right_attribute IN ('brand', 'name'))"""


STAT_CTE = """,
wide AS (SELECT id, scope, grp, avg(v) AS mean, sum(v) AS sum, count(*)::DOUBLE AS count, min(v) AS min, max(v) AS max,
                max(v) - min(v) AS M_m, median(v) AS median FROM members GROUP BY ALL)"""


def _stat(s: str) -> str:
    return s.replace("-", "_")


LONG_STATS = ",\nst AS (" + " UNION ALL ".join(
    f"SELECT id, scope, grp, '{s}' AS stat, {_stat(s)}::DOUBLE AS v FROM wide" for s in STATS) + ")"


def feature_ctes(fill_first: bool = False) -> str:
    """All features long: base values of present or implied classes, then derived ones, then zeros."""
    fill = "true" if fill_first else "scope <> 'allattr'"
    return STAT_CTE + LONG_STATS + f""",
keys AS (SELECT DISTINCT id, scope, stat FROM st),
piv AS (
  SELECT id, scope, stat, max(v) FILTER (grp = 'all') AS a, max(v) FILTER (grp = 'paired') AS p, max(v) FILTER (grp = 'unpaired') AS u,
         max(v) FILTER (grp = 'unpaired_both') AS b0, max(v) FILTER (grp = 'unpaired_exclusive') AS e0,
         max(v) FILTER (grp = 'left') AS l0, max(v) FILTER (grp = 'right') AS r0 FROM st GROUP BY ALL),
filled AS (
  SELECT id, scope, stat, a, CASE WHEN {fill} THEN coalesce(p, 0) ELSE p END AS p, CASE WHEN {fill} THEN coalesce(u, 0) ELSE u END AS u,
         CASE WHEN {fill} OR u IS NOT NULL THEN coalesce(b0, 0) END AS b, CASE WHEN {fill} OR u IS NOT NULL THEN coalesce(e0, 0) END AS e,
         CASE WHEN {fill} OR l0 IS NOT NULL OR r0 IS NOT NULL THEN least(coalesce(l0, 0), coalesce(r0, 0)) END AS lo,
         CASE WHEN {fill} OR l0 IS NOT NULL OR r0 IS NOT NULL THEN greatest(coalesce(l0, 0), coalesce(r0, 0)) END AS hi
  FROM piv),
present AS (
  SELECT id, stat || '_paired_' || scope AS feature, p AS value FROM filled
  UNION ALL SELECT id, stat || '_unpaired_' || scope, u FROM filled
  UNION ALL SELECT id, stat || '_all_' || scope, a FROM filled WHERE scope = '{ALL}'
  UNION ALL SELECT id, stat || '_unpaired_both_' || scope, b FROM filled WHERE scope = '{ALL}'
  UNION ALL SELECT id, stat || '_unpaired_exclusive_' || scope, e FROM filled WHERE scope = '{ALL}'
  UNION ALL SELECT id, stat || '_unpaired_min_' || scope, lo FROM filled WHERE scope = '{ALL}'
  UNION ALL SELECT id, stat || '_unpaired_max_' || scope, hi FROM filled WHERE scope = '{ALL}'""" + "".join(f"""
  UNION ALL SELECT id, stat || '_perc{x}_' || scope, p / (1e-9 + p + {c}) FROM filled {w}
  UNION ALL SELECT id, stat || '_diff{x}_' || scope, p - {c} FROM filled {w}""" for x, c, w in (
        ("", "u", ""), *((x, c, f"WHERE scope = '{ALL}'") for x, c in (("_both", "b"), ("_exclusive", "e"), ("_min", "lo"), ("_max", "hi"))))) + f"""),
names AS (SELECT unnest([{', '.join(repr(n) for n in NAMES)}]) AS feature),
feat AS (SELECT i.id, n.feature, coalesce(p.value, 0.0) AS value FROM (SELECT DISTINCT id FROM units) i CROSS JOIN names n
         LEFT JOIN present p ON p.id = i.id AND p.feature = n.feature),
coef AS (SELECT unnest([{', '.join(repr(n) for n in NAMES)}]) AS feature, unnest([{', '.join(str(c) for c in COEF.values())}])::DOUBLE AS coef),
logit AS (SELECT id, sum(value * coef) - 1.0 AS z FROM feat JOIN coef USING (feature) GROUP BY id),
score AS (SELECT p.id, p.label, coalesce(1 / (1 + exp(-z)), 0.5) AS match_score FROM pairs p LEFT JOIN logit USING (id))"""


MEMBERS = UNITS + member_ctes()
FEATURES = MEMBERS + feature_ctes()
ROUND = "round(value, 6) + 0.0::DOUBLE AS value"


def stats_query(groups: tuple[str, ...], pred: str = "cos_sim", complementary: bool = True) -> str:
    cols = ", ".join(f"round({_stat(s)}, 6) + 0.0::DOUBLE AS {_stat(s)}" for s in STATS)
    return sql(UNITS + member_ctes(pred, complementary) + STAT_CTE,
               f"SELECT id, grp, {cols} FROM wide WHERE scope = '{ALL}' AND grp IN ({', '.join(repr(g) for g in groups)})")


# ---- shares ------------------------------------------------------------------------------------------------

def share_ctes(mode: str = "proportional") -> str:
    g = "PARTITION BY id, scope, grp"
    x = {"max": "10 * v / nullif(hi, 0)", "min": "-10 * v / nullif(lo, 0)"} if mode == "proportional" else {"max": "10 * v", "min": "-10 * v"}
    return f""",
g0 AS (SELECT *, count(*) OVER w AS n, max(v) OVER w AS hi, min(v) OVER w AS lo, median(v) OVER w AS mid FROM members WINDOW w AS ({g})),
g1 AS (SELECT *, coalesce({x['max']}, 0) AS xa, coalesce({x['min']}, 0) AS xi, -10 * abs(v - mid) AS xm FROM g0),
g2 AS (SELECT *, exp(xa - max(xa) OVER w) AS ea, exp(xi - max(xi) OVER w) AS ei, exp(xm - max(xm) OVER w) AS em FROM g1 WINDOW w AS ({g})),
sh AS (SELECT id, unit_no, scope, grp, v, n, v / n AS mean, v AS sum, 1.0::DOUBLE AS count,
         CASE WHEN lo = 0 THEN 0 ELSE lo * ei / sum(ei) OVER w END AS min, CASE WHEN hi = 0 THEN 0 ELSE hi * ea / sum(ea) OVER w END AS max,
         CASE WHEN mid = 0 THEN 0 ELSE mid * em / sum(em) OVER w END AS median FROM g2 WINDOW w AS ({g})),
shares AS (SELECT id, unit_no, scope, grp, v, mean, sum, count, min, max, max - min AS M_m, median FROM sh)"""


SHARES = MEMBERS + share_ctes()
CONTRIB = SHARES + ",\nslong AS (" + " UNION ALL ".join(
    f"SELECT id, unit_no, scope, grp, '{s}' AS stat, {_stat(s)}::DOUBLE AS x FROM shares" for s in STATS) + f"""),
sides AS (SELECT *, coalesce(sum(x) FILTER (grp = 'left') OVER w, 0) < coalesce(sum(x) FILTER (grp = 'right') OVER w, 0) AS less
          FROM slong WHERE grp IN ('left', 'right') WINDOW w AS (PARTITION BY id, scope, stat)),
base AS (
  SELECT id, unit_no, scope, grp, stat, x FROM slong WHERE grp NOT IN ('left', 'right')
  UNION ALL SELECT id, unit_no, scope, 'unpaired_min', stat, CASE WHEN (grp = 'left') = less THEN x ELSE 0 END FROM sides
  UNION ALL SELECT id, unit_no, scope, 'unpaired_max', stat, CASE WHEN (grp = 'left') = less THEN 0 ELSE x END FROM sides),
suffixed AS (
  SELECT id, unit_no, scope, grp, stat, x, unnest(CASE WHEN grp = 'paired' AND scope = '{ALL}' THEN ['', '_both', '_exclusive', '_min', '_max']
         WHEN grp = 'paired' THEN [''] ELSE [substr(grp, 9)] END) AS suffix FROM base WHERE grp <> 'all'),
signed AS (SELECT *, CASE WHEN grp = 'paired' THEN x ELSE -x END AS d FROM suffixed),
sums AS (SELECT *, coalesce(sum(d) FILTER (grp = 'paired') OVER w, 0) AS a, coalesce(-sum(d) FILTER (grp <> 'paired') OVER w, 0) AS b,
         coalesce(sum(d) FILTER (d > 0) OVER w, 0) AS pos, coalesce(-sum(d) FILTER (d < 0) OVER w, 0) AS neg
         FROM signed WINDOW w AS (PARTITION BY id, scope, stat, suffix)),
contrib AS (
  SELECT id, unit_no, stat || '_' || grp || '_' || scope AS feature, x AS value FROM base
  UNION ALL SELECT id, unit_no, stat || '_diff' || suffix || '_' || scope, d FROM signed
  UNION ALL SELECT id, unit_no, stat || '_perc' || suffix || '_' || scope,
    CASE WHEN abs(a) < 1e-12 THEN 0 WHEN d > 0 THEN d * (a*a + a*b + b*b) / ((a+b)*(a+b) + 1e-9) / (pos + 1e-9)
         WHEN d < 0 THEN d * b*b / ((a+b)*(a+b) + 1e-9) / (neg + 1e-9) ELSE 0 END FROM sums)"""
EXPLAINED = FEATURES + CONTRIB[len(MEMBERS):] + """,
tc AS (SELECT id, unit_no, sum(value * coef) AS tc FROM contrib JOIN coef USING (feature) GROUP BY ALL),
expl AS (SELECT u.*, coalesce(t.tc, 0) AS tc FROM valued u LEFT JOIN tc t USING (id, unit_no))"""
TC = "round(tc, 6) + 0.0::DOUBLE AS token_contribution"
BOTH = "left_word <> '[UNP]' AND right_word <> '[UNP]'"
TOKEN_ROWS = f"""SELECT id, unit_no, label, 'left_' || left_attribute AS attribute, left_pos AS pos, left_word AS word, CASE WHEN {BOTH} THEN tc / 2 ELSE tc END AS tc FROM expl WHERE left_word <> '[UNP]'
  UNION ALL SELECT id, unit_no, label, 'right_' || right_attribute, right_pos, right_word, CASE WHEN {BOTH} THEN tc / 2 ELSE tc END FROM expl WHERE right_word <> '[UNP]'"""


def shares_query(stats: list[str], mode: str = "proportional") -> str:
    cols = ", ".join(f"round({_stat(s)}, 6) + 0.0::DOUBLE AS {_stat(s)}" for s in stats)
    return f"SELECT id, unit_no, scope, grp, {cols} FROM shares"


def contrib_query(pattern: str) -> str:
    return sql(CONTRIB, f"SELECT * FROM (SELECT id, unit_no, feature, {ROUND} FROM contrib WHERE regexp_matches(feature, '{pattern}')) WHERE value <> 0")


INDEX_SHARES = MEMBERS + """,
g0 AS (SELECT *, row_number() OVER (PARTITION BY id, scope, grp ORDER BY v DESC, unit_no) AS rhi,
              row_number() OVER (PARTITION BY id, scope, grp ORDER BY v, unit_no) AS rlo,
              (rank() OVER (PARTITION BY id, scope, grp ORDER BY v) + (count(*) OVER (PARTITION BY id, scope, grp, v) - 1) / 2.0)
                / count(*) OVER (PARTITION BY id, scope, grp) AS pct FROM members),
g1 AS (SELECT *, row_number() OVER (PARTITION BY id, scope, grp ORDER BY round(abs(pct - 0.5), 12), unit_no) AS rmid FROM g0)"""

METRICS = """SELECT {by}, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6)::DOUBLE AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6)::DOUBLE AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)::DOUBLE AS f1
  FROM (SELECT {by}, count(*) FILTER (hit AND y) AS tp, count(*) FILTER (hit AND NOT y) AS fp, count(*) FILTER (NOT hit AND y) AS fn FROM ({rows}) GROUP BY {by})"""
SPLIT = "CASE WHEN id % 5 <= 2 THEN 'train' WHEN id % 5 = 3 THEN 'valid' ELSE 'test' END AS split"
SPLIT_ROWS = f"SELECT {SPLIT}, match_score > 0.5 AS hit, label = 1 AS y FROM score"
A15 = METRICS.format(by="split", rows=SPLIT_ROWS)


# ---- cleaning ----------------------------------------------------------------------------------------------

# Characters dropped when they stand alone, in the order they are applied.
LONE = ["!", '"', "#", "%", "&", "'", "(", ")", "*", "+", ",", "-", "/", ":", ";", "<", "=", ">", "?", "@", "[", "\\", "]", "^", "_", "`", "{", "|", "}", "~"]


def clean(col: str) -> str:
    out = f"regexp_replace({col}, '[^\\x00-\\x7F]', '', 'g') || ' '"
    for ch in LONE:
        quoted = ch.replace("'", "''")
        out = f"replace({out}, ' {quoted} ', ' ')"
    out = f"translate({out}, '-/\\', '   ')"
    return f"lower(trim(regexp_replace({out}, '{WS}', ' ', 'g')))"


def latin1_again(col: str) -> str:
    bytes_ = f"from_hex(array_to_string(list_transform(string_split({col}, ''), lambda c: printf('%02x', unicode(c))), ''))"
    return f"CASE WHEN regexp_full_match({col}, '(?s)[\\x{{00}}-\\x{{FF}}]*') THEN coalesce(TRY(decode({bytes_})), {col}) ELSE {col} END"


def repaired(col: str) -> str:
    steps = [(" _", ""), (r"\. \.", "."), ("1/2", "½"), ("Ã(.) ", r"Ã\1"), ("é(.) ", r"e\1")]
    for pattern, new in steps:
        col = f"regexp_replace({col}, '{pattern}', '{new}', 'g')"
    return col


# ---- sampling and curves ----------------------------------------------------------------------------------

def sample(size: int, seed: int) -> str:
    return f"""SELECT id, label FROM (
  SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '{seed}', id::VARCHAR)), id) AS rk,
         floor({size} * (count(*) OVER (PARTITION BY label) / (SELECT count(*) FROM pairs))) AS want FROM pairs) WHERE rk <= want"""


def pareto(keys: str) -> str:
    return f"""SELECT {keys}, pct::INT AS pct, cum / nullif(total, 0) AS share FROM (
  SELECT {keys}, unnest([1,3,5,10,20,30,40,50,60,70,80,90,100]) AS pct, rn, n, cum, total FROM (
    SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY x DESC, unit_no) AS rn, count(*) OVER (PARTITION BY {keys}) AS n,
           sum(x) OVER (PARTITION BY {keys} ORDER BY x DESC, unit_no ROWS UNBOUNDED PRECEDING) AS cum, sum(x) OVER (PARTITION BY {keys}) AS total
    FROM (SELECT *, abs(tc) AS x, CASE WHEN tc > 0 THEN 'Positive' ELSE 'Negative' END AS sign FROM expl))) WHERE ceil(pct * n / 100) = rn"""


VEC_SUM = "round(list_sum({v}), 6) + 0.0::DOUBLE AS {n}"
CORRELATION = f"""SELECT id, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) + 0.0::DOUBLE AS correlation, count(*) AS n_words FROM (
  SELECT id, attribute, pos, round(sum(tc), 9) AS x FROM ({TOKEN_ROWS}) GROUP BY ALL)
  JOIN (SELECT id, attribute, pos, round(sum(tc), 9) AS y FROM ({TOKEN_ROWS.replace('tc / 2', 'pred / 2').replace('ELSE tc END', 'ELSE pred END')}) GROUP BY ALL) USING (id, attribute, pos) GROUP BY id"""

ORACLES: dict[str, str] = {
    "S1": sql(PAIRS, "SELECT id, left_id, right_id, label, left_brand, left_name, right_brand, right_name FROM pairs"),
    "S2": "SELECT p_partkey AS id, p_name AS name FROM part",
    "S3": sql(UNITS, "SELECT id, unit_no, left_word, right_word, cos_sim, left_attribute, right_attribute, label FROM units"),
    "S3_stages": sql(UNITS, "SELECT id, unit_no, left_word, right_word, cos_sim, left_attribute, right_attribute, label, TRUE AS reused FROM units"),
    "S4": sql(TOKENS + VOCAB, "SELECT p_partkey AS id, pos, attr, ptok.word, " + VEC_SUM.format(v="vec", n="vec_sum") + " FROM ptok JOIN vocab USING (word)"),
    "S6": sql(FEATURES, A15),
    "S7": sql(EXPLAINED, f"SELECT id, attribute, pos, word, polarity, round(sum(tc), 6) + 0.0::DOUBLE AS impact FROM (SELECT *, CASE WHEN label = 1 THEN 'positive' ELSE 'negative' END AS polarity FROM ({TOKEN_ROWS})) GROUP BY ALL"),
    "S8": sql(PAIRS, " UNION ALL ".join(f"SELECT *, {n} AS train_size, {r} AS rep FROM ({sample(n, r)})" for n in (500, 1000, 2000) for r in range(3))),
    "P1": sql(PAIRS, "SELECT id, left_brand, left_name, right_brand, right_name FROM pairs"),
    "P2": sql(PAIRS, "SELECT left_brand, left_name, right_brand, right_name, count(*) AS n, 'x' AS kind FROM pairs GROUP BY ALL UNION ALL SELECT label::VARCHAR, '', '', '', count(*), 'y' FROM pairs GROUP BY label"),
    "P3": f"SELECT doc_id, {_ascii('text')} AS text, lang FROM documents",
    "P4": f"SELECT doc_id, nullif(nullif({clean('strip_accents(text)')}, 'None'), 'nan') AS text, lang FROM documents",
    "P5": f"SELECT doc_id, {latin1_again('text')} AS text, lang FROM (SELECT doc_id, {repaired('text')} AS text, lang FROM documents)",
    "P6": "SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN NULL ELSE lang END AS lang FROM documents",
    "P7": sql(PAIRS, "SELECT id, concat_ws(' ', left_brand, left_name) AS \"left\", concat_ws(' ', right_brand, right_name) AS \"right\" FROM gaps"),
    "P8": sql(PAIRS, "SELECT coalesce(left_brand, 'nan') || ' ' || left_name AS \"left\", right_brand || ' ' || right_name AS \"right\", label, count(*) AS n FROM gaps GROUP BY ALL"),
    "P9": f"SELECT doc_id, 'text' AS attr, count(*) AS n_words, (count(*) - 1)::INT AS last_pos, count(DISTINCT w) AS n_distinct FROM (SELECT doc_id, unnest({words('text')}) AS w FROM documents) GROUP BY doc_id",
    "P10": sql(TOKENS, "SELECT id, side, attr, attr_pos, pos, word FROM tok"),
    "P11": "SELECT row_number() OVER (ORDER BY md5(concat_ws('|', '0', doc_id::VARCHAR)), doc_id) - 1 AS id, doc_id FROM documents",
    "P12": "SELECT p_partkey AS id, 1 AS label, p_partkey AS left_id, p_name AS left_name, p_brand AS left_brand FROM part",
    "P13": sql(PAIRS, "SELECT id, coalesce(left_brand, '') AS left_brand FROM gaps"),
    "P14": sql(PAIRS, "SELECT id, label, left_brand, left_name, left_brand AS right_brand, left_name AS right_name, 'left_' AS mirror_side FROM pairs UNION ALL SELECT id, label, right_brand, right_name, right_brand, right_name, 'right_' FROM pairs"),
    "P15": sql(EXPLAINED, f"SELECT id, unit_no, label, attribute, pos, word, {TC} FROM ({TOKEN_ROWS})"),
    "P16": sql(EXPLAINED, "SELECT left_word, right_word, CASE WHEN tc >= 0 THEN 'green' ELSE 'red' END AS colour, count(*) AS n, round(sum(tc), 6) + 0.0::DOUBLE AS score FROM expl WHERE abs(tc) >= 0.1 GROUP BY ALL"),
    "F1": sql(PAIRS, "SELECT p_partkey AS id, p_name AS name, p_brand AS brand FROM part WHERE p_partkey IN (SELECT left_id FROM pairs WHERE label = 1)"),
    "F2": sql(MEMBERS, "SELECT id, unit_no, paired AS is_paired FROM valued"),
    "F3": sql(MEMBERS, "SELECT id, unit_no, CASE WHEN exclusive THEN 'exclusive' ELSE 'both' END AS side FROM valued WHERE NOT paired"),
    "F4": sql(MEMBERS, f"SELECT scope, grp, count(*) AS n FROM members WHERE scope <> '{ALL}' GROUP BY ALL"),
    "F5": sql(FEATURES, "SELECT id, label, round(match_score, 6) AS match_score FROM score WHERE label > 0.5 OR match_score >= 0.01"),
    "F6": sql(UNITS, "SELECT id, unit_no, left_word, right_word FROM units WHERE id IN (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '0', id::VARCHAR)), id) AS rk FROM pairs) WHERE rk <= 100)"),
    "F7": sql(UNITS, "SELECT right_word, count(*) AS n FROM units WHERE right_word <> '[UNP]' GROUP BY ALL"),
    "J1": sql(PAIRS, "SELECT id, left_id, right_id, label, left_name, left_brand, right_name, right_brand FROM pairs"),
    "J2": sql(EDGES, "SELECT id, l AS left_pos, r AS right_pos, lw AS left_word, rw AS right_word, s AS sim FROM grid WHERE s >= 0.6"),
    "J3": sql(EDGES, "SELECT id, side, pos, word FROM tok t WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g.id = t.id AND g.s >= 0.75 AND ((t.side = 'left' AND g.l = t.pos) OR (t.side = 'right' AND g.r = t.pos)))"),
    "J4": sql(UNITS, "SELECT id, unit_no, left_word, right_word, round(avg(CASE WHEN label = 0 AND cos_sim >= 0.7 THEN 0.5 WHEN label = 1 AND cos_sim < 0.5 THEN 0.5 ELSE label END) OVER (PARTITION BY left_word, right_word), 6) AS label_corrected_mean FROM units"),
    "J5": sql(MEMBERS + STAT_CTE, f"SELECT id, round(max(mean) FILTER (grp = 'paired'), 6) + 0.0::DOUBLE AS mean_paired, round(max(mean) FILTER (grp = 'unpaired'), 6) + 0.0::DOUBLE AS mean_unpaired FROM wide WHERE scope = '{ALL}' AND grp IN ('paired', 'unpaired') GROUP BY id"),
    "J6": sql(EXPLAINED, f"SELECT id, unit_no, pred, {TC} FROM expl"),
    "J7": sql(TOKENS + VOCAB, "SELECT p_partkey AS id, pos, ptok.word, " + VEC_SUM.format(v="vec", n="vec_sum") + " FROM ptok JOIN vocab USING (word)"),
    "J8": sql(FEATURES, "SELECT id, round(z + 1.0, 6) + 0.0::DOUBLE AS logit FROM logit"),
    "J9": sql(FEATURES, "SELECT id, round(CASE WHEN label = 1 THEN match_score ELSE 0.5 END, 6) AS match_score FROM score"),
    "J10": sql(TOKENS, "SELECT p.id, p.label, (SELECT string_agg(lw, ' ' ORDER BY l) FROM lt WHERE lt.id = p.id) AS left_words, (SELECT string_agg(rw, ' ' ORDER BY r) FROM rt WHERE rt.id = p.id) AS right_words FROM pairs p"),
    "M1": sql(VECTOR_GRID, "SELECT id, l AS left_pos, r AS right_pos, lw AS left_word, rw AS right_word, s AS sim FROM grid WHERE s >= 0.6"),
    "M2": sql(EDGES, "SELECT id, l AS left_pos, r AS right_pos, lw AS left_word, rw AS right_word, s AS sim, 'jaro_winkler' AS kind FROM grid WHERE s >= 0.8 UNION ALL SELECT * FROM (SELECT id, l, r, lw, rw, round(1 - levenshtein(lw, rw) / greatest(length(lw), length(rw)), 9) AS sim, 'edit' FROM grid) WHERE sim >= 0.5"),
    "M3": sql(EDGES + flat_slots(0.60, None) + UNITS_TAIL, "SELECT id, left_pos, right_pos, cos_sim FROM units WHERE left_pos >= 0 AND right_pos >= 0"),
    "M4": sql(FLAT_UNITS, "SELECT id, left_pos, right_pos, cos_sim FROM units"),
    "M5": sql(EDGES + flat_slots(2.0, 0.85) + UNITS_TAIL, "SELECT id, left_pos, right_pos, cos_sim FROM units"),
    "M6": sql(FLAT_UNITS, "SELECT id, left_word, right_word, cos_sim FROM units"),
    "M7": sql(UNITS, f"SELECT {NO_NUMBER} FROM units WHERE pass_no = 1"),
    "M8": sql(EDGES + schema_slots(unpair=0.9) + UNITS_TAIL, f"SELECT {NO_NUMBER} FROM units WHERE pass_no = 2"),
    "M9": sql(UNITS, f"SELECT {NO_NUMBER} FROM units WHERE pass_no >= 3"),
    "M10": sql(UNITS, f"SELECT {VIEW} FROM units"),
    "M11": sql(FLAT_UNITS, f"SELECT {VIEW} FROM units"),
    "M12": sql(VECTOR_UNITS, f"SELECT {VIEW} FROM units"),
    "M13": sql(EDGES + schema_slots(0.7, 0.8, 0.9) + UNITS_TAIL, f"SELECT {VIEW.replace('label', '0 AS label')} FROM units"),
    "M14": sql(VECTOR_UNITS + """,
sv AS (SELECT id, side, avg(list_sum(vec)) AS s FROM tok JOIN vocab USING (word) GROUP BY ALL)""",
        "SELECT u.id, u.unit_no, round((a.s + b.s) / 2, 6) + 0.0::DOUBLE AS sentence_sum FROM units u JOIN sv a ON a.id = u.id AND a.side = 'left' JOIN sv b ON b.id = u.id AND b.side = 'right'"),
    "E2": sql(TOKENS + VOCAB, """SELECT p_partkey AS id, pos, word, round(CASE WHEN length(word) > 3 THEN (list_sum(list_transform(a.embedding, lambda x: x::DOUBLE)) + list_sum(list_transform(b.embedding, lambda x: x::DOUBLE))) / 2 ELSE list_sum(list_transform(a.embedding, lambda x: x::DOUBLE)) END, 6) + 0.0::DOUBLE AS vec_sum
  FROM ptok JOIN embeddings a ON a.vec_id = least(length(word), 3) LEFT JOIN embeddings b ON b.vec_id = length(word) - 1 AND length(word) > 3"""),
    "E4": sql(TOKENS + VOCAB, "SELECT p_partkey AS id, round(avg(vec[1]), 6) + 0.0::DOUBLE AS first, round(avg(vec[64]), 6) + 0.0::DOUBLE AS last FROM ptok JOIN vocab USING (word) GROUP BY 1"),
    "N1": sql(VECTOR_UNITS, """SELECT id, unit_no, round(list_sum(list_transform(z, lambda p: (p[1] + p[2]) / 2)), 6) + 0.0::DOUBLE AS mean_sum, round(list_sum(list_transform(z, lambda p: abs(p[1] - p[2]))), 6) + 0.0::DOUBLE AS diff_sum
  FROM (SELECT id, unit_no, list_transform(range(1, 65), lambda i: [coalesce(a.vec[i], 0), coalesce(b.vec[i], 0)]) AS z FROM units LEFT JOIN vocab a ON a.word = left_word LEFT JOIN vocab b ON b.word = right_word)"""),
    "N2": sql(VECTOR_UNITS, "SELECT id, unit_no, c::DOUBLE AS label_corrected, round(avg(c) OVER (PARTITION BY left_word, right_word), 6)::DOUBLE AS label_corrected_mean FROM (SELECT *, CASE WHEN label = 0 AND cos_sim >= 0.7 THEN 0.5 WHEN label = 1 AND cos_sim < 0.5 THEN 0.5 ELSE label END AS c FROM units)"),
    "N5": sql(UNITS, "SELECT id, unit_no, cos_sim AS pred FROM units"),
    "N6": sql(UNITS, "SELECT id, unit_no, CASE WHEN cos_sim > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS pred FROM units"),
    "N7": """WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[64]::DOUBLE AS b FROM embeddings)
SELECT vec_id, round(0.5 * (tanh((a - (SELECT avg(a) FROM v)) / (SELECT stddev_pop(a) FROM v)) + 1), 6) AS first,
       round(0.5 * (tanh((b - (SELECT avg(b) FROM v)) / (SELECT stddev_pop(b) FROM v)) + 1), 6) AS last FROM v""",
    "A1": stats_query(("all",)),
    "A2": stats_query(("paired",)),
    "A3": f"SELECT *, true AS complementary FROM ({stats_query(('unpaired',))}) UNION ALL SELECT *, false FROM ({stats_query(('unpaired',), complementary=False)})",
    "A4": stats_query(("unpaired_exclusive", "unpaired_both")),
    "A5": stats_query(("left", "right")),
    "A6": sql(FEATURES, f"SELECT id, feature, {ROUND} FROM feat WHERE regexp_matches(feature, '_unpaired_(min|max)_allattr$')"),
    "A7": sql(FEATURES, f"SELECT id, feature, {ROUND} FROM feat WHERE regexp_matches(feature, '_(perc|diff).*_allattr$')"),
    "A8": sql(FEATURES, f"SELECT id, feature, {ROUND} FROM feat WHERE NOT regexp_matches(feature, '_allattr$')"),
    "A9": sql(FEATURES, f"SELECT id, feature, {ROUND} FROM feat WHERE regexp_matches(feature, '_allattr$')"),
    "A10": sql(FEATURES, f"SELECT id, feature, {ROUND} FROM feat"),
    "A11": sql(FEATURES, "SELECT id, " + ", ".join(f"round(max(value) FILTER (feature = '{s}_{g}_{ALL}'), 6) + 0.0::DOUBLE AS {s}_{g}" for g in ("paired", "unpaired", "all") for s in ("mean", "count")) + " FROM feat GROUP BY id"),
    "A12": sql(FEATURES, f"SELECT id, feature, {ROUND} FROM feat WHERE regexp_matches(feature, '^(mean|sum|count)_') AND NOT regexp_matches(feature, '_(perc|diff)_')  AND NOT regexp_matches(feature, '^(mean|sum|count)_(perc|diff)')"),
    "A13": sql(UNITS, "SELECT left_word, right_word, round(avg(label), 6) AS label, round(avg(cos_sim), 6) AS cos_sim, round(avg(CASE WHEN label = 0 AND cos_sim >= 0.7 THEN 0.5 WHEN label = 1 AND cos_sim < 0.5 THEN 0.5 ELSE label END), 6) AS label_corrected FROM units GROUP BY ALL"),
    "A14": sql(PAIRS, "SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM pairs), 6) AS share FROM pairs GROUP BY label"),
    "A15": sql(FEATURES, A15),
    "A19": sql(UNITS, "SELECT count(DISTINCT id) AS n_ids, count(*) AS n_units FROM units"),
    "A21": sql(EXPLAINED, f"SELECT sign, pct, round(avg(share), 6) AS share FROM ({pareto('id, sign')}) GROUP BY ALL UNION ALL SELECT 'total', pct, round(avg(share), 6) FROM ({pareto('id')}) GROUP BY pct"),
    "W1": sql(SHARES, shares_query(["mean", "sum", "count"])),
    "W2": sql(SHARES, shares_query(["min", "max", "median"])),
    "W3": sql(SHARES, shares_query(["M-m"])),
    "W4": f"SELECT *, 'softmax' AS mode FROM ({sql(MEMBERS + share_ctes('softmax'), shares_query(['min', 'max', 'median']))}) UNION ALL SELECT *, 'index' FROM (" + sql(
        INDEX_SHARES, "SELECT id, unit_no, scope, grp, round(CASE WHEN rlo = 1 THEN v ELSE 0 END, 6) + 0.0::DOUBLE AS min, round(CASE WHEN rhi = 1 THEN v ELSE 0 END, 6) + 0.0::DOUBLE AS max, round(CASE WHEN rmid = 1 THEN v ELSE 0 END, 6) + 0.0::DOUBLE AS median FROM g1") + ")",
    "W5": sql(INDEX_SHARES, "SELECT id, scope, grp, unit_no FROM g1 WHERE rmid = 1"),
    "W6": contrib_query("_unpaired_(min|max)_allattr$"),
    "W7": contrib_query("_diff"),
    "W8": contrib_query("_perc"),
    "W9": contrib_query("."),
    "W10": sql(EXPLAINED, f"SELECT id, unit_no, left_word, right_word, {TC} FROM expl"),
    "W11": sql(EXPLAINED, f"SELECT id, sign, pct, round(share, 6) AS share FROM ({pareto('id, sign')})"),
    "W12": sql(PAIRS, sample(500, 0)),
    "O1": sql(EDGES, "SELECT id, (row_number() OVER (PARTITION BY id ORDER BY s DESC, l, r) - 1)::INT AS rank, l, r FROM grid WHERE s >= 0.6"),
    "O2": sql(PAIRS, "SELECT id, label FROM pairs ORDER BY id"),
    "O3": sql(FEATURES, f"SELECT split AS model_name, f1 FROM ({A15}) ORDER BY f1 DESC, split LIMIT 1"),
    "O4": sql(FEATURES, "SELECT arg_max(q, f1 * 1000 + q) AS best_q, round(max(f1), 6) AS best_f1 FROM (" + METRICS.format(
        by="q", rows="SELECT i / 10 AS q, match_score > i / 10 AS hit, label = 1 AS y FROM score CROSS JOIN range(1, 10) t(i)") + ")"),
    "O5": sql(UNITS, "SELECT id, rank, unit_no, round(cos_sim - 0.5, 6) + 0.0::DOUBLE AS impact FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos_sim DESC, unit_no)::INT AS rank FROM units) WHERE rank <= 5"),
    "U1": sql(UNITS, "SELECT id, left_word, right_word, pass_no FROM units WHERE pass_no IN (1, 2, 3, 4)"),
    "U2": sql(UNITS, "SELECT DISTINCT left_word, right_word FROM units"),
    "U3": sql(TOKENS, "SELECT DISTINCT word FROM tok WHERE side = 'left' EXCEPT SELECT word FROM tok WHERE side = 'right' AND attr = 'name'"),
    "C7": sql(FEATURES, "SELECT id, round(match_score, 6) AS match_score FROM score"),
    "C8": sql(EXPLAINED, f"SELECT e.id, unit_no, left_word, right_word, pred, {TC}, round(match_score, 6) AS match_score FROM expl e JOIN score s USING (id)"),
    "C9": sql(UNITS + member_ctes("CASE WHEN cos_sim > 0 THEN 1.0 ELSE 0.0 END::DOUBLE") + feature_ctes(), "SELECT id, round(match_score, 6) AS match_score FROM score"),
    "X1": sql(UNITS, "SELECT id, unit_no, round(cos_sim - 0.5, 6) + 0.0::DOUBLE AS impact FROM units"),
    "X2": sql(TOKENS, "SELECT id, side || '_' || attr || '__' || attr_pos AS word_key, word FROM tok"),
    "X6": sql(EXPLAINED, CORRELATION),
}


# ---- perturbation: explain, remove or keep words, and run the whole matcher again on the rebuilt text ------

K, ROUNDS = 5, 3


def perturbed_ctes(keep: bool) -> str:
    name = "top" if keep else "MoRF"

    def text(side: str, attr: str) -> str:
        return f"coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (side = '{side}' AND attr = '{attr}'), '') AS {side}_{attr}"

    flag = "" if keep else "NOT "
    draws = ", ".join(f"row_number() OVER (PARTITION BY id ORDER BY md5(concat_ws('|', '{i}', id::VARCHAR, unit_no::VARCHAR)), unit_no) AS r{i}" for i in range(1, ROUNDS + 1))
    more = " ".join(f"UNION ALL SELECT *, s + {i * K}, 'random{i}_' || s FROM ranks, steps WHERE r{i} <= s" for i in range(1, ROUNDS + 1))
    return EXPLAINED + f""",
ranks AS (SELECT id, unit_no, label, left_pos, right_pos, tc, row_number() OVER (PARTITION BY id ORDER BY round(tc, 9) DESC, unit_no) AS r0,
          {draws} FROM expl),
steps AS (SELECT unnest(range(1, {K + 1})) AS s),
plan AS (
  SELECT *, s AS comb_no, '{name}_' || s AS comb_name FROM ranks, steps WHERE r0 <= s
  {more}),
touched AS (SELECT id, label, comb_no, comb_name, sum(tc) AS expected_delta, list(left_pos) AS ls, list(right_pos) AS rs FROM plan GROUP BY ALL),
kept AS (SELECT t.id, t.comb_no, side, attr, pos, word FROM touched t JOIN tok k ON k.id = t.id
         WHERE {flag}list_contains(CASE WHEN side = 'left' THEN ls ELSE rs END, pos)),
ppairs AS (SELECT t.id::VARCHAR || '#' || t.comb_no AS id, t.id AS pair_id, t.comb_no, comb_name, expected_delta, label,
  {text('left', 'brand')}, {text('left', 'name')}, {text('right', 'brand')}, {text('right', 'name')}
  FROM touched t LEFT JOIN kept k ON k.id = t.id AND k.comb_no = t.comb_no GROUP BY t.id, t.comb_no, comb_name, expected_delta, label),
again AS (WITH RECURSIVE pairs AS (SELECT id, label, left_brand, left_name, right_brand, right_name FROM ppairs){FEATURES[len(PAIRS):]}
  SELECT id, match_score FROM score),
results AS (SELECT p.pair_id AS id, comb_name, p.label, s.match_score AS start_pred, n.match_score AS new_pred, expected_delta,
  s.match_score - n.match_score AS detected_delta, expected_delta - (s.match_score - n.match_score) AS error
  FROM ppairs p JOIN again n ON n.id = p.id JOIN score s ON s.id = p.pair_id)"""


REMOVED, KEPT = perturbed_ctes(False), perturbed_ctes(True)


def _r(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in cols)


AOPC = "SELECT comb, avg(v) AS aopc FROM (SELECT id, CASE WHEN comb_name LIKE 'MoRF%' THEN 'MoRF' ELSE 'random' END AS comb, avg(detected_delta) AS v FROM results GROUP BY ALL) GROUP BY comb"
CONCORDANCE = "SELECT comb_name, avg(((detected_delta > 0) = (expected_delta > 0))::INT) AS concorde FROM results GROUP BY comb_name"
LOSS = "SELECT comb_name, a.f1 AS start_f1, b.f1 AS new_f1, a.f1 - b.f1 AS delta_f1 FROM ({}) a JOIN ({}) b USING (comb_name)".format(*[
    METRICS.format(by="comb_name", rows=f"SELECT comb_name, {c} > 0.5 AS hit, label = 1 AS y FROM results").replace(", 6)::DOUBLE AS f1", ", 12)::DOUBLE AS f1")
    for c in ("start_pred", "new_pred")])
ORACLES |= {
    "A16": sql(REMOVED, f"SELECT comb, {_r('aopc')} FROM ({AOPC})"),
    "A17": sql(KEPT, "SELECT comb, round(avg(v), 6) + 0.0::DOUBLE AS sufficiency FROM (SELECT id, CASE WHEN comb_name LIKE 'top%' THEN 'top' ELSE 'random' END AS comb, avg(((start_pred > 0.5) = (new_pred > 0.5))::INT) AS v FROM results GROUP BY ALL) GROUP BY comb"),
    "A18": sql(REMOVED, f"SELECT comb_name, size, {_r('mean', 'min', 'max', 'median', 'concorde')} FROM (SELECT comb_name, count(*) AS size, avg(detected_delta) AS mean, min(detected_delta) AS min, max(detected_delta) AS max, median(detected_delta) AS median FROM results GROUP BY comb_name) JOIN ({CONCORDANCE}) USING (comb_name)"),
    "A20": sql(REMOVED, f"SELECT id, comb_name, {_r('expected_delta', 'error')} FROM results"),
    "X3": sql(REMOVED, "SELECT id, comb_name, left_brand, left_name, right_brand, right_name FROM ppairs"),
    "X4": sql(REMOVED, f"SELECT id, comb_name, label, {_r('start_pred', 'new_pred', 'expected_delta', 'detected_delta', 'error')} FROM results"),
    "X5": sql(REMOVED, f"SELECT comb_name, {_r('start_f1', 'new_f1', 'delta_f1')} FROM ({LOSS})"),
    "X7": sql(REMOVED, "SELECT measure, key, round(value, 6) + 0.0::DOUBLE AS value FROM ("
              f"SELECT 'aopc' AS measure, comb AS key, aopc AS value FROM ({AOPC}) UNION ALL SELECT 'concordance', comb_name, concorde FROM ({CONCORDANCE}) "
              f"UNION ALL SELECT 'delta_f1', comb_name, delta_f1 FROM ({LOSS}) "
              f"UNION ALL SELECT 'pareto_' || lower(sign), pct::VARCHAR, avg(share) FROM ({pareto('id, sign')}) GROUP BY ALL "
              + "".join(f"UNION ALL SELECT 'delta_{m}', comb_name, {f}::DOUBLE FROM results GROUP BY comb_name " for m, f in (
                  ("size", "count(*)"), ("mean", "avg(detected_delta)"), ("min", "min(detected_delta)"), ("max", "max(detected_delta)"), ("median", "median(detected_delta)"))) +
              f"UNION ALL SELECT 'correlation', 'mean', avg(correlation) FROM ({CORRELATION}) UNION ALL SELECT 'correlation', 'pairs', count(correlation)::DOUBLE FROM ({CORRELATION}) "
              f"UNION ALL SELECT 'pareto_total', pct::VARCHAR, avg(share) FROM ({pareto('id')}) GROUP BY ALL)"),
}

# ---- whole documents as records -------------------------------------------------------------------

ORACLES["J2_documents"] = f"""
WITH d AS (SELECT doc_id, list_concat({words(_ascii("coalesce(lang, '')"))}, {words(_ascii("coalesce(text, '')"))}) AS ws,
                  lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS nxt FROM documents),
w AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
p AS (SELECT d.doc_id, a.w AS x, b.w AS y, a.n * b.n AS n FROM d JOIN w a ON a.doc_id = d.doc_id JOIN w b ON b.doc_id = d.nxt),
s AS (SELECT doc_id, n, j + k * 0.1 * (1 - j) AS s FROM (SELECT doc_id, n, jaro_similarity(x, y) AS j,
  CASE WHEN x[1] <> y[1] THEN 0 WHEN x[:2] <> y[:2] OR length(x) < 2 THEN 1 WHEN x[:3] <> y[:3] OR length(x) < 3 THEN 2 WHEN x[:4] <> y[:4] OR length(x) < 4 THEN 3 ELSE 4 END AS k FROM p)),
e AS (SELECT doc_id, count(*) AS n_pairs, coalesce(sum(n) FILTER (round(s, 9) >= 0.6), 0)::BIGINT AS n_edges,
  coalesce(sum(n * round(s, 9)) FILTER (round(s, 9) >= 0.6), 0) AS sim_sum FROM s GROUP BY doc_id)
SELECT d.doc_id AS id, (len(d.ws) * len(o.ws))::BIGINT AS n_cells, coalesce(n_pairs, 0)::BIGINT AS n_pairs, coalesce(n_edges, 0)::BIGINT AS n_edges,
  round(coalesce(sim_sum, 0), 4) + 0.0::DOUBLE AS sim_sum
FROM d JOIN d o ON o.doc_id = d.nxt LEFT JOIN e ON e.doc_id = d.doc_id"""

# one proposal of every pair a step: ``nxt`` is each asker's next choice, ``held`` whom each chooser holds
ORACLES["M3_preferences"] = f"""
WITH RECURSIVE {TOKENS},
side AS (SELECT id, list(word ORDER BY pos) FILTER (side = 'left') AS lw, list(word ORDER BY pos) FILTER (side = 'right') AS rw FROM tok GROUP BY id),
prefs AS (SELECT id, len(lw) > len(rw) AS turned,
  list_transform(lw, lambda x: list_transform(list_sort(list_transform(range(len(rw)), lambda j: [levenshtein(x, rw[j + 1]), j])), lambda p: p[2])) AS lp,
  list_transform(rw, lambda y: list_transform(list_sort(list_transform(range(len(lw)), lambda i: [abs(length(lw[i + 1]) - length(y)), i])), lambda p: p[2])) AS rp
  FROM side WHERE lw IS NOT NULL AND rw IS NOT NULL),
asked AS (SELECT id, turned, CASE WHEN turned THEN rp ELSE lp END AS a, CASE WHEN turned THEN lp ELSE rp END AS b FROM prefs),
run AS (
  SELECT id, turned, a, b, list_transform(a, lambda x: 1) AS nxt, list_transform(b, lambda x: -1) AS held FROM asked
  UNION ALL
  SELECT id, turned, a, b, list_transform(nxt, lambda n, i: CASE WHEN i = f + 1 THEN n + 1 ELSE n END),
    list_transform(held, lambda h, i: CASE WHEN i = c + 1 AND (h < 0 OR list_position(b[i], f) < list_position(b[i], h)) THEN f ELSE h END)
  FROM (SELECT *, a[f + 1][nxt[f + 1]] AS c FROM (SELECT *, list_filter(range(len(a)), lambda x: NOT list_contains(held, x))[1] AS f FROM run) WHERE f IS NOT NULL)),
done AS (SELECT * FROM run WHERE len(list_filter(range(len(a)), lambda x: NOT list_contains(held, x))) = 0),
pairs_found AS (SELECT id, turned, unnest(held) AS f, unnest(range(len(held))) AS c FROM done)
SELECT id, (CASE WHEN turned THEN c ELSE f END)::INT AS left_pos, (CASE WHEN turned THEN f ELSE c END)::INT AS right_pos FROM pairs_found WHERE f >= 0"""

_W = [[((i * 37 + k * 5) % 11 - 5) / 10 for i in range(128)] for k in range(2)]
ORACLES["N4"] = sql(VECTOR_UNITS, f"""SELECT id, unit_no, round(1 / (1 + exp(-(0.7 * greatest(list_dot_product(x, {_W[0]}::DOUBLE[]) + 0.1, 0) - 0.4 * greatest(list_dot_product(x, {_W[1]}::DOUBLE[]) - 0.2, 0) + 0.05))), 6) AS pred
  FROM (SELECT id, unit_no, list_concat(list_transform(z, lambda p: (p[1] + p[2]) / 2), list_transform(z, lambda p: abs(p[1] - p[2])))::DOUBLE[] AS x
    FROM (SELECT id, unit_no, list_transform(range(1, 65), lambda i: [coalesce(a.vec[i], 0)::DOUBLE, coalesce(b.vec[i], 0)::DOUBLE]) AS z FROM units LEFT JOIN vocab a ON a.word = left_word LEFT JOIN vocab b ON b.word = right_word))""")


def _grams(table: str) -> str:
    """Word and bucket of every n-gram of three to six letters of the word in marks."""
    return f"""SELECT word, ('0x' || md5(m[i:i + n - 1])[:4])::INT % 16384 AS bucket FROM (
  SELECT word, m, n, unnest(range(1, greatest(length(m) - n + 2, 1))) AS i FROM (SELECT word, '<' || word || '>' AS m, unnest([3, 4, 5, 6]) AS n FROM {table}))"""


ORACLES["E3_subwords"] = sql(TOKENS + VOCAB + f""",
v AS (SELECT word, list_sum(list_transform(vec, lambda x: x::DOUBLE)) AS s FROM vocab),
b AS (SELECT bucket, avg(s) AS s FROM (SELECT DISTINCT word, bucket FROM ({_grams('v')})) JOIN v USING (word) GROUP BY bucket),
every AS (SELECT word FROM ptok UNION SELECT unnest({words(_ascii("coalesce(text, '')"))}) FROM documents),
rule AS (SELECT bucket, sum((bucket * 37 + k * 101) % 201 - 100) / 1000 AS s FROM range(16384) t(bucket), range(64) u(k) GROUP BY bucket)""",
    f"SELECT word, round(avg(coalesce(b.s, rule.s)), 6) + 0.0::DOUBLE AS vec_sum FROM ({_grams('every')}) g LEFT JOIN b ON b.bucket = g.bucket JOIN rule ON rule.bucket = g.bucket GROUP BY word")

ORACLES["E2_pieces"] = f"""
WITH RECURSIVE {TOKENS + VOCAB},
ws AS (SELECT DISTINCT word FROM ptok),
runs AS (SELECT DISTINCT CASE WHEN i > 1 THEN '##' ELSE '' END || word[i:i + n - 1] AS piece, n
  FROM (SELECT word, n, unnest(range(1, length(word) - n + 2)) AS i FROM ws, range(1, 5) t(n) WHERE length(word) >= n)),
kept AS (SELECT piece, ('0x' || md5(piece)[:8])::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id FROM runs WHERE n = 1 OR md5(piece)[:1] < '8'),
pv AS (SELECT piece, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS s FROM kept JOIN embeddings USING (vec_id)),
cut AS (
  SELECT word, 0 AS at, ''::VARCHAR AS piece FROM ws
  UNION ALL
  SELECT c.word, c.at + n, p FROM (
    SELECT c.word, c.at, n, CASE WHEN c.at > 0 THEN '##' ELSE '' END || c.word[c.at + 1:c.at + n] AS p FROM cut c, range(1, 5) t(n) WHERE c.at + n <= length(c.word)) c
  WHERE p IN (SELECT piece FROM pv)
  QUALIFY row_number() OVER (PARTITION BY c.word ORDER BY n DESC) = 1),
mean AS (SELECT word, count(*) AS n_pieces, avg(s) AS s FROM cut JOIN pv USING (piece) GROUP BY word)
SELECT p_partkey AS id, pos, word, n_pieces, round(s, 6) + 0.0::DOUBLE AS vec_sum FROM ptok JOIN mean USING (word)"""
