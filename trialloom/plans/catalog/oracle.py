"""SQL text of the study views for DuckDB; each query adds its own last step."""

from __future__ import annotations

from trialloom import registry as reg
from trialloom.functions.keyed import KEY_STEPS, MULTIPLIERS, ROUNDS, WORD, keyed_seed

EPOCH = 1704067200000000
DAY = 86400000000
HALF = 21600000000

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, text: str, *needs: str) -> None:
    VIEWS[name] = (needs, text)


def sql(body: str, *needs: str, recursive: bool = False) -> str:
    order: list[str] = []

    def add(n):
        if n in order:
            return
        for d in VIEWS[n][0]:
            add(d)
        order.append(n)

    for n in needs:
        add(n)
    if not order:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n" + body


def field_text(columns: str) -> str:
    """Text of a row that tells fields apart, of comma-separated column names."""
    return " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '~')" for c in columns.split(", "))


STATE = "CASE code WHEN 0 THEN 'N' WHEN 1 THEN 'C' ELSE 'E' END"


def near(source: str, keys: str, extra: str = "") -> str:
    return f"""SELECT *, lead(s) OVER w AS nxt, lag(s) OVER w AS prv FROM (
      SELECT {keys}, cycle, code, {STATE} AS s {extra} FROM {source})
      WINDOW w AS (PARTITION BY {keys} ORDER BY cycle)"""


def metrics(source: str, keys: str) -> str:
    """Counts per unit from a neighbour view."""
    cols = [f"count(*) FILTER (s = '{a}') AS N_{a}" for a in reg.STATES]
    cols += [f"count(*) FILTER (s = '{a}' AND nxt = '{b}') AS N_{a}{b}" for a in reg.STATES for b in reg.STATES]
    cols += [f"count(*) FILTER (s = '{a}' AND nxt IS NOT NULL) AS N_{a}dot" for a in reg.STATES]
    cols += ["count(*) FILTER (s <> 'C' AND coalesce(prv = 'C', true)) AS N_run_NC",
             "count(*) FILTER (s <> 'C') AS Sum_L_NC_obs",
             "count(*) FILTER (s <> 'C' AND nxt IS NULL) AS N_open_NC",
             "count(*) FILTER (code = 2) AS N_E_H", "count(*) FILTER (code = 3) AS N_E_F",
             "max(s) FILTER (nxt IS NULL) AS EndState"]
    return f"SELECT {keys}, {', '.join(cols)} FROM {source} GROUP BY {keys}"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


view("b", """SELECT CAST(json_extract_string(props, '$.k') AS INT) % 4 AS cond, user_id AS unit, event_id, ts, event_type, value
  FROM events""")
view("m", """SELECT cond, unit, 'A' AS method, event_id, ts,
    CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 0 ELSE 1 END AS code FROM b
  UNION ALL
  SELECT cond, unit, 'B', event_id, ts,
    CASE WHEN value < 2 THEN 0 WHEN value < 6 THEN 2 WHEN value < 10 THEN 3 ELSE 1 END FROM b""", "b")
view("seq", """SELECT cond, unit, method, code,
    row_number() OVER (PARTITION BY cond, unit, method ORDER BY ts, event_id) AS cycle FROM m""", "m")
view("sn", near("seq", "cond, unit, method"), "seq")
view("rm", metrics("sn", "cond, unit, method"), "sn")
view("cand", f"""SELECT user_id AS unit, (epoch_us(ts) - {EPOCH}) // {DAY} AS cycle, epoch_us(ts) - {EPOCH} AS t_us,
    value AS w, event_id AS rank, CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 1 END AS source_code
  FROM events""")
view("gates", f"""SELECT u.unit, d.cycle, d.cycle * {DAY} + {DAY // 2} AS ref_us, {HALF} AS half_us, 20.0::DOUBLE AS w_ref
  FROM (SELECT DISTINCT unit FROM cand) u CROSS JOIN (SELECT DISTINCT cycle FROM cand) d""", "cand")
view("inside", """SELECT c.*, g.ref_us, g.half_us, g.w_ref,
    ((c.t_us - g.ref_us) / 3600000000.0::DOUBLE) * ((c.t_us - g.ref_us) / 3600000000.0::DOUBLE) AS q_t,
    ((c.w - g.w_ref) / 10.0::DOUBLE) * ((c.w - g.w_ref) / 10.0::DOUBLE) AS q_w
  FROM cand c JOIN gates g USING (unit, cycle)
  WHERE c.t_us >= g.ref_us - g.half_us AND c.t_us < g.ref_us + g.half_us""", "cand", "gates")
SCORE = {"FIRST": "t_us", "LAST": "-t_us", "T": "q_t", "W": "q_w", "TW": "q_t + q_w"}
view("picked", " UNION ALL ".join(
    f"""SELECT unit, cycle, {o} AS method_ord, '{c}' AS method, t_us, w, rank, source_code FROM (
      SELECT *, row_number() OVER (PARTITION BY unit, cycle ORDER BY {SCORE[c]}, rank) AS pos FROM inside) WHERE pos = 1"""
    for o, c, _ in reg.METHODS), "inside")
view("method_list", "SELECT * FROM (VALUES " + ", ".join(
    f"({o}, '{c}', '{n}')" for o, c, n in reg.METHODS) + ") t(method_ord, method, name_zh)")
view("study", """SELECT CAST(g.unit % 19 AS INT) AS cond, g.unit // 19 + 1 AS unit, l.method_ord, l.method,
    g.cycle + 1 AS cycle, coalesce(p.source_code, 0) AS code
  FROM gates g CROSS JOIN method_list l
  LEFT JOIN picked p ON p.unit = g.unit AND p.cycle = g.cycle AND p.method = l.method""", "gates", "method_list", "picked")
view("tn", near("study", "cond, unit, method_ord, method"), "study")
view("srm", metrics("tn", "cond, unit, method_ord, method"), "tn")
view("code", "SELECT DISTINCT CAST(l_orderkey % 65535 + 1 AS INT) AS u16 FROM lineitem")
view("conditions", "SELECT * FROM (VALUES " + ", ".join(
    "({}, '{}', '{}', {}::DOUBLE, {}::DOUBLE)".format(o, c, s, "NULL" if r is None else repr(r), "NULL" if d is None else repr(d))
    for o, c, s, r, d in reg.CONDITIONS) + ") t(ConditionOrdinal, ConditionCode, Scene, HPRF_Hz, FDelay_s)")
view("metric_list", "SELECT * FROM (VALUES " + ", ".join(
    f"({o}, '{m}', '{d}', {reg.TARGETS[m]}::DOUBLE)" for o, m, d in reg.METRICS) + ") t(metric_ord, metric, direction, target)")
view("contrast_list", "SELECT * FROM (VALUES " + ", ".join(
    f"({o}, '{c}', '{m}')" for o, c, m in reg.CONTRASTS) + ") t(contrast_ord, contrast, comparator)")


def totals(source: str, keys: str) -> str:
    return (f"SELECT {keys}, count(*) AS R, " + ", ".join(f"{big(f'sum({c})')} AS Total_{c}" for c in reg.COUNTS)
            + f" FROM {source} GROUP BY {keys}")


view("tot", totals("rm", "cond, method"), "rm")
view("stot", totals("srm", "cond, method"), "srm")


def ratio_columns(metrics13) -> str:
    out = []
    for m, (n, d, r) in metrics13.items():
        den = {"_cycles": "(Total_N_C + Total_N_E + Total_N_N)"}.get(d, d)
        out += [f"CASE WHEN {den} > 0 THEN CAST({n} AS DOUBLE) / {den} END AS {m}_value", f"{den} > 0 AS {m}_defined",
                f"CASE WHEN {den} > 0 THEN NULL ELSE '{r or 'EMPTY'}' END AS {m}_undefined_reason"]
    return ", ".join(out)


def pairs(source: str, keys: str, k: int | None = None) -> str:
    """Long (metric, a, b) per unit."""
    parts = []
    for m, (a, b, _) in reg.CORE_RATIOS.items():
        den = b or ("N_C + Sum_L_NC_obs" if k is None else str(k))
        parts.append(f"SELECT {keys}, '{m}' AS metric, {a} AS a, {big(den)} AS b FROM {source}")
    return " UNION ALL ".join(parts)


view("pairs", pairs("rm", "cond, unit, method"), "rm")
view("spairs", pairs("srm", "cond, unit, method"), "srm")


def influence(source: str) -> str:
    return f"""SELECT *, a - theta * b AS num, (a - theta * b) / bbar AS psi FROM (
      SELECT *, CASE WHEN sum(b) OVER w > 0 THEN CAST(sum(a) OVER w AS DOUBLE) / CAST(sum(b) OVER w AS DOUBLE) END AS theta,
        nullif(CAST(sum(b) OVER w AS DOUBLE), 0) / count(*) OVER w AS bbar
      FROM {source} WINDOW w AS (PARTITION BY cond, method, metric))"""


view("infl", influence("pairs"), "pairs")
view("sinfl", influence("spairs"), "spairs")
REASON = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{r or 'EMPTY'}'" for m, (_, _, r) in reg.CORE_RATIOS.items()) + " END"


def points(source: str) -> str:
    return f"""SELECT cond, method, metric, {big('sum(a)')} AS sum_a, {big('sum(b)')} AS sum_b,
      count(*) FILTER (b > 0) AS positive_units,
      CASE WHEN sum(b) > 0 THEN CAST(sum(a) AS DOUBLE) / CAST(sum(b) AS DOUBLE) END AS estimate, sum(b) > 0 AS defined,
      CASE WHEN sum(b) > 0 THEN '' ELSE {REASON} END AS undefined_reason
    FROM {source} GROUP BY cond, method, metric"""


view("pts", points("pairs"), "pairs")
view("spts", points("(SELECT * FROM spairs WHERE cond > 0)"), "spairs")
UCB, Z = reg.VARIANCE_UCB, reg.Z975
SUPPORT = f"(metric = 'P_cor' OR (sum_b >= {reg.MIN_DENOMINATOR} AND positive_units >= {reg.MIN_POSITIVE_UNITS}))"


def plan_columns(v: str) -> str:
    return f"""{v} * {UCB} AS upper_variance, CAST(ceil({Z * Z!r} * ({v} * {UCB}) / (target * target)) AS BIGINT) AS required_r,
      {Z} * sqrt({v} * {UCB} / 1000.0) AS half_width_1000, {Z} * sqrt({v} * {UCB} / 2000.0) AS half_width_2000"""


PASSES = """coalesce(defined AND support AND required_r <= 1000, false) AS pass_1000,
  coalesce(defined AND support AND required_r <= 2000, false) AS pass_2000, coalesce(required_r > 2000, false) AS exceeds_2000"""


def planned(infl: str) -> str:
    return f"""SELECT *, {PASSES} FROM (SELECT *, {plan_columns('variance')} FROM (
      SELECT cond, method, metric, target, sum_b > 0 AS defined,
        CASE WHEN sum_b > 0 THEN '' ELSE 'ZERO_TOTAL_DENOMINATOR' END AS undefined_reason, sum_a, sum_b, positive_units,
        {SUPPORT} AS support, theta, mean_b, variance FROM (
        SELECT cond, method, metric, any_value(target) AS target, {big('sum(a)')} AS sum_a, {big('sum(b)')} AS sum_b,
          count(*) FILTER (b > 0) AS positive_units, any_value(theta) AS theta, any_value(bbar) AS mean_b,
          var_samp(psi) AS variance
        FROM {infl} JOIN metric_list USING (metric) GROUP BY cond, method, metric)))"""


def planned_pair(infl: str, first: str, second: str) -> str:
    return f"""SELECT *, {PASSES} FROM (SELECT *, theta_2 - theta_1 AS delta, {plan_columns('variance')} FROM (
      SELECT cond, metric, target, ok1 AND ok2 AS defined,
        concat_ws(';', CASE WHEN NOT ok1 THEN 'T_UNDEFINED' END, CASE WHEN NOT ok2 THEN 'TW_UNDEFINED' END) AS undefined_reason,
        CASE WHEN ok1 AND ok2 THEN th1 END AS theta_1, CASE WHEN ok1 AND ok2 THEN th2 END AS theta_2,
        CASE WHEN ok1 AND ok2 THEN v END AS variance,
        (metric = 'P_cor' OR (sb1 >= 100 AND p1 >= 30)) AND (metric = 'P_cor' OR (sb2 >= 100 AND p2 >= 30)) AS support FROM (
        SELECT x.cond, x.metric, any_value(target) AS target, sum(x.b) > 0 AS ok1, sum(y.b) > 0 AS ok2, any_value(x.theta) AS th1,
          any_value(y.theta) AS th2, var_samp(y.psi - x.psi) AS v, sum(x.b) AS sb1, sum(y.b) AS sb2,
          count(*) FILTER (x.b > 0) AS p1, count(*) FILTER (y.b > 0) AS p2
        FROM (SELECT * FROM {infl} WHERE method = '{first}') x JOIN (SELECT * FROM {infl} WHERE method = '{second}') y
          ON x.cond = y.cond AND x.unit = y.unit AND x.metric = y.metric
        JOIN metric_list l ON l.metric = x.metric GROUP BY x.cond, x.metric)))"""


view("ind", planned("infl"), "infl", "metric_list")
view("par", planned_pair("infl", "A", "B"), "infl", "metric_list")
CELL_COLS = "metric, defined, support, required_r, half_width_2000, pass_1000, exceeds_2000"
view("cells", f"""SELECT 'INDIVIDUAL' AS kind, cond, method AS scope, {CELL_COLS}, sum_b, positive_units FROM ind
  UNION ALL SELECT 'PAIRED', cond, 'T-TW', {CELL_COLS}, NULL, NULL FROM par""", "ind", "par")


def words(name: str, source: str, keys: str, counter: tuple[str, str, str, str], key: tuple[int, int]) -> str:
    """Register the ten rounds over ``source``; the last view has w0..w3."""
    m0, m1 = MULTIPLIERS
    start = ", ".join(f"CAST({c} AS UBIGINT) AS c{i}" for i, c in enumerate(counter))
    needs = (source,) if source in VIEWS else ()
    view(f"{name}_0", f"SELECT {keys}, {start} FROM {source}", *needs)
    k = list(key)
    for r in range(ROUNDS):
        if r:
            k = [(a + b) & WORD for a, b in zip(k, KEY_STEPS)]
        names = [f"c{i}" for i in range(4)] if r + 1 < ROUNDS else [f"w{i}" for i in range(4)]
        out = (f"xor(xor((c2 * {m1}::UBIGINT) >> 32, c1), {k[0]}::UBIGINT)", f"(c2 * {m1}::UBIGINT) & {WORD}::UBIGINT",
               f"xor(xor((c0 * {m0}::UBIGINT) >> 32, c3), {k[1]}::UBIGINT)", f"(c0 * {m0}::UBIGINT) & {WORD}::UBIGINT")
        target = f"{name}_{r + 1}" if r + 1 < ROUNDS else name
        view(target, f"SELECT {keys}, " + ", ".join(f"{e} AS {n}" for e, n in zip(out, names)) + f" FROM {name}_{r}", f"{name}_{r}")
    return name


BOOT_KEY = keyed_seed("BOOTSTRAP", "BOOTSTRAP_INDEX")
BOOTS = 50
view("addr", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) % 4 AS cond, user_id + 1 AS unit FROM events")
words("ew", "addr", "event_id", ("cond", "unit", "event_id & 4294967295", "event_id >> 32"), keyed_seed("PILOT", "TIE_H"))


def draw_views(prefix: str, units: str) -> None:
    """Draw positions, two tries of words and the unit ids."""
    view(f"{prefix}_pos", f"""SELECT cond, boot, unit AS draw, count(*) OVER (PARTITION BY cond, boot) AS r
      FROM (SELECT DISTINCT cond, unit FROM {units}) CROSS JOIN (SELECT unnest(range(1, {BOOTS + 1})) AS boot)""", units)
    for t in (0, 1):
        words(f"{prefix}_w{t}", f"{prefix}_pos", "cond, boot, draw, r", ("cond", "boot", str(t), "draw - 1"), BOOT_KEY)

    def unit(w):
        return f"CASE WHEN {w} < 4294967296 - 4294967296 % r THEN CAST({w} % r AS BIGINT) + 1 END"

    view(f"{prefix}_draws", f"""SELECT cond, CAST(boot AS INT) AS boot, CAST(draw AS BIGINT) AS draw, coalesce(
        {unit('a.w0')}, {unit('b.w0')}) AS unit FROM {prefix}_w0 a JOIN (SELECT cond, boot, draw, w0 FROM {prefix}_w1) b
      USING (cond, boot, draw)""".replace("% r", "% a.r"), f"{prefix}_w0", f"{prefix}_w1")


view("seq_units", "SELECT DISTINCT cond, unit + 1 AS unit FROM rm", "rm")
view("study_units", "SELECT DISTINCT cond, unit FROM srm WHERE cond > 0", "srm")
draw_views("q", "seq_units")
draw_views("s", "study_units")
# units with gaps, renumbered from 1
view("thin", "SELECT *, dense_rank() OVER (PARTITION BY cond ORDER BY unit) AS dense FROM rm WHERE unit % 7 <> 3", "rm")
view("thin_units", "SELECT DISTINCT cond, dense AS unit FROM thin", "thin")
draw_views("t", "thin_units")


def dist(draws: str, pairs_: str) -> str:
    return f"""SELECT d.cond, d.boot, p.method, p.metric,
      CASE WHEN sum(b) > 0 THEN CAST(sum(a) AS DOUBLE) / CAST(sum(b) AS DOUBLE) END AS value, sum(b) > 0 AS defined
    FROM {draws} d JOIN {pairs_} p ON p.cond = d.cond AND p.unit = d.unit GROUP BY d.cond, d.boot, p.method, p.metric"""


view("pairs1", "SELECT cond, unit + 1 AS unit, method, metric, a, b FROM pairs", "pairs")
view("qdist", dist("q_draws", "pairs1"), "q_draws", "pairs1")
view("sdist", dist("s_draws", "spairs"), "s_draws", "spairs")
view("scon", """SELECT x.cond, x.boot, x.metric, l.contrast_ord, l.contrast, l.comparator, x.value - y.value AS value,
    x.value IS NOT NULL AND y.value IS NOT NULL AS defined
  FROM sdist x CROSS JOIN contrast_list l
  JOIN sdist y ON y.cond = x.cond AND y.boot = x.boot AND y.metric = x.metric AND y.method = l.comparator
  WHERE x.method = 'TW'""", "sdist", "contrast_list")
FEW = "INSUFFICIENT_DEFINED_BOOTSTRAP_REPLICATES"


def ci(source: str, keys: str) -> str:
    return f"""SELECT *, defined_count >= 2 AS ci_defined, CASE WHEN defined_count >= 2 THEN '' ELSE '{FEW}' END AS ci_reason,
      CASE WHEN defined_count >= 2 THEN lo END AS ci_lower, CASE WHEN defined_count >= 2 THEN hi END AS ci_upper FROM (
      SELECT {keys}, count(*) AS boots, count(value) AS defined_count, count(*) - count(value) AS undefined_count,
        CAST(count(value) AS DOUBLE) / count(*) AS defined_fraction, quantile_cont(value, 0.025) AS lo,
        quantile_cont(value, 0.975) AS hi FROM {source} GROUP BY {keys})"""


view("sci", ci("sdist", "cond, method, metric"), "sdist")
view("pci", ci("scon", "cond, contrast_ord, contrast, comparator, metric"), "scon")
CI_SQL = """CAST(boots AS BIGINT) AS BootstrapB, defined_count AS DefinedBootstrapCount, undefined_count AS UndefinedBootstrapCount,
  defined_fraction AS DefinedFraction, ci_defined AS CI95Defined, ci_reason AS CI95UndefinedReason, ci_lower AS CI95Lower,
  ci_upper AS CI95Upper, ci_upper - ci_lower AS CI95Width"""


def verdict(applicable: str, known: str) -> str:
    return f"""{applicable} AS Stage8PrecisionContractApplicable, CASE WHEN {applicable} THEN target END AS Stage8TargetHalfWidth,
      CASE WHEN {applicable} AND CI95Defined AND {known} THEN MaxOneSidedHalfWidth <= target END AS MeetsStage8PrecisionTarget"""


HALVES = "CASE WHEN {p} IS NOT NULL AND ci_lower IS NOT NULL THEN greatest({p} - ci_lower, ci_upper - {p}) END AS MaxOneSidedHalfWidth"
view("isum", f"""SELECT * EXCLUDE (target), {verdict("MethodCode IN ('T', 'TW')", "PointDefined")} FROM (
    SELECT p.cond AS ConditionOrdinal, c.ConditionCode, l.method_ord AS MethodOrdinal, p.method AS MethodCode, p.metric AS Metric,
      sum_a AS FormalSumA, sum_b AS FormalSumB, positive_units AS FormalPositiveDenominatorRepeatCount, estimate AS PointEstimate,
      defined AS PointDefined, undefined_reason AS PointUndefinedReason, {CI_SQL}, {HALVES.format(p='estimate')}, target
    FROM spts p JOIN sci USING (cond, method, metric) JOIN conditions c ON c.ConditionOrdinal = p.cond
    JOIN method_list l USING (method) JOIN metric_list USING (metric))""", "spts", "sci", "conditions", "method_list", "metric_list")
view("psum", f"""SELECT * EXCLUDE (target), {verdict("(ContrastOrdinal = 0)", "DeltaPointDefined")} FROM (
    SELECT i.cond AS ConditionOrdinal, c.ConditionCode, i.contrast_ord AS ContrastOrdinal, i.contrast AS ContrastCode,
      i.comparator AS ComparatorMethod, i.metric AS Metric, x.estimate AS PointEstimateTW, y.estimate AS PointEstimateComparator,
      x.estimate - y.estimate AS DeltaPoint, x.defined AND y.defined AS DeltaPointDefined,
      CASE WHEN x.defined AND y.defined THEN '' ELSE 'TW_OR_COMPARATOR_FORMAL_POINT_UNDEFINED' END AS DeltaPointUndefinedReason,
      {CI_SQL}, {HALVES.format(p='(x.estimate - y.estimate)')}, target
    FROM pci i JOIN spts x ON x.cond = i.cond AND x.metric = i.metric AND x.method = 'TW'
    JOIN spts y ON y.cond = i.cond AND y.metric = i.metric AND y.method = i.comparator
    JOIN conditions c ON c.ConditionOrdinal = i.cond JOIN metric_list l ON l.metric = i.metric)""",
     "pci", "spts", "conditions", "metric_list")
AUDIT = """CI95Defined, CI95Lower, CI95Upper, MaxOneSidedHalfWidth AS ActualMaxOneSidedHalfWidth, Stage8TargetHalfWidth AS TargetHalfWidth,
  MeetsStage8PrecisionTarget, true AS Stage8PrecisionContractApplicable, false AS FailureToMeetTargetFailsStage10"""
RANK = "CASE Metric WHEN 'P_cor' THEN 0 WHEN 'P_C_given_C' THEN 1 WHEN 'P_C_given_E' THEN 2 ELSE 3 END"
view("audit", f"""SELECT (ConditionOrdinal - 1) * 8 + CASE MethodCode WHEN 'T' THEN 0 ELSE 4 END + {RANK} + 1 AS AuditOrdinal,
    'INDIVIDUAL' AS InferenceType, ConditionOrdinal, ConditionCode, MethodCode AS MethodOrContrast, Metric, PointEstimate, {AUDIT}
  FROM isum WHERE MethodCode IN ('T', 'TW')
  UNION ALL SELECT 144 + (ConditionOrdinal - 1) * 4 + {RANK} + 1, 'PAIRED', ConditionOrdinal, ConditionCode, ContrastCode, Metric,
    DeltaPoint, {AUDIT} FROM psum WHERE ContrastOrdinal = 0""", "isum", "psum")
view("levels", f"SELECT cond, unit, method, cycle, code, cycle % 16 AS ref_level, unit % 16 AS unit_level FROM seq", "seq")
STRATUM = """CASE WHEN abs(ref_level - unit_level) = 0 THEN 'WIDTH_STRATUM_0NS' WHEN abs(ref_level - unit_level) = 1
  THEN 'WIDTH_STRATUM_10NS' ELSE 'WIDTH_STRATUM_GE20NS' END"""
view("stratum_list", "SELECT unnest(['WIDTH_STRATUM_0NS', 'WIDTH_STRATUM_10NS', 'WIDTH_STRATUM_GE20NS']) AS stratum")


def strata(source: str, near_view: str, keys: str) -> str:
    k = [x.strip() for x in keys.split(",")]
    on = " AND ".join(f"x.{c} = u.{c}" for c in k)
    return f"""SELECT {', '.join(f'u.{c}' for c in k)}, l.stratum, count(x.cycle) AS cycles,
      count(*) FILTER (x.s = 'C') AS correct, count(*) FILTER (x.s = 'E') AS errors,
      count(*) FILTER (x.s = 'C' AND x.nxt = 'E') AS c_to_e
    FROM (SELECT DISTINCT {keys} FROM {source}) u CROSS JOIN stratum_list l
    LEFT JOIN (SELECT n.*, {STRATUM} AS stratum FROM {near_view} n) x ON {on} AND x.stratum = l.stratum
    GROUP BY {', '.join(f'u.{c}' for c in k)}, l.stratum"""


view("ln", near("levels", "cond, unit, method", ", ref_level, unit_level"), "levels")
view("strata", strata("levels", "ln", "cond, unit, method"), "ln", "stratum_list", "levels")


def strata_pool(source: str, keys: str) -> str:
    return f"""SELECT {keys}, stratum, {big('sum(cycles)')} AS total_cycles, {big('sum(correct)')} AS total_correct,
      {big('sum(errors)')} AS total_errors, {big('sum(c_to_e)')} AS total_c_to_e, count(*) FILTER (cycles > 0) AS supported_units,
      CAST(sum(correct) AS DOUBLE) / nullif(CAST(sum(cycles) AS DOUBLE), 0) AS p_correct,
      CAST(sum(errors) AS DOUBLE) / nullif(CAST(sum(cycles) AS DOUBLE), 0) AS p_error FROM {source} GROUP BY {keys}, stratum"""


view("spool", strata_pool("strata", "method"), "strata")
view("slevels", """SELECT cond, unit, method, cycle, code, cycle % 16 AS ref_level, unit % 16 AS unit_level
  FROM study WHERE cond = 3""", "study")
view("sln", near("slevels", "cond, unit, method", ", ref_level, unit_level"), "slevels")
view("sstrata", strata("slevels", "sln", "cond, unit, method"), "sln", "stratum_list", "slevels")
view("sspool", strata_pool("sstrata", "method"), "sstrata")
# Closed loop: one row per unit, rule and cycle with the reference before the cycle.
LOOP = {"FIRST": "c.t_us", "LAST": "-c.t_us",
        "T": "((c.t_us - t.ref) / 3600000000.0) * ((c.t_us - t.ref) / 3600000000.0)",
        "W": "((c.w - 20.0) / 10.0) * ((c.w - 20.0) / 10.0)"}
LOOP["TW"] = f"{LOOP['T']} + {LOOP['W']}"
LOOP_SCORE = "CASE t.method " + " ".join(f"WHEN '{m}' THEN CAST({e} AS DOUBLE)" for m, e in LOOP.items()) + " END"
LOOP_ON = f"c.unit = t.unit AND c.cycle = t.cycle AND c.t_us >= t.ref - {HALF} AND c.t_us < t.ref + {HALF}"
view("walk", f"""SELECT unit, method, 0::BIGINT AS cycle, {DAY // 2}::DOUBLE AS ref
    FROM (SELECT DISTINCT unit FROM cand) CROSS JOIN method_list
  UNION ALL
  SELECT t.unit, t.method, t.cycle + 1, coalesce(CAST(first(c.t_us ORDER BY {LOOP_SCORE}, c.rank) FILTER (c.t_us IS NOT NULL) AS DOUBLE), t.ref) + {DAY}
  FROM walk t LEFT JOIN cand c ON {LOOP_ON} WHERE t.cycle < (SELECT max(cycle) FROM cand) GROUP BY t.unit, t.method, t.cycle, t.ref""", "cand", "method_list")
# The same with cycles left out: a unit goes from each of its cycles to the next it has.
view("some_cycles", """SELECT unit, cycle, row_number() OVER w AS k, lead(cycle) OVER w AS next FROM gates
  WHERE cycle = 0 OR (unit + cycle) % 4 <> 1 WINDOW w AS (PARTITION BY unit ORDER BY cycle)""", "gates")
view("gap_walk", f"""SELECT unit, method, 0::BIGINT AS cycle, 1::BIGINT AS k, {DAY // 2}::DOUBLE AS ref
    FROM (SELECT DISTINCT unit FROM cand) CROSS JOIN method_list
  UNION ALL
  SELECT t.unit, t.method, s.next, t.k + 1, coalesce(CAST(first(c.t_us ORDER BY {LOOP_SCORE}, c.rank) FILTER (c.t_us IS NOT NULL) AS DOUBLE),
    t.ref) + {DAY} * (s.next - t.cycle)
  FROM gap_walk t JOIN some_cycles s ON s.unit = t.unit AND s.k = t.k LEFT JOIN cand c ON {LOOP_ON}
  WHERE s.next IS NOT NULL GROUP BY t.unit, t.method, t.cycle, t.k, t.ref, s.next""", "cand", "method_list", "some_cycles")
view("gap_trace", f"""SELECT t.unit, t.cycle, t.method, count(c.t_us) AS candidates,
    CAST(first(c.t_us ORDER BY {LOOP_SCORE}, c.rank) FILTER (c.t_us IS NOT NULL) AS DOUBLE) AS picked_time,
    CAST(coalesce(first(c.source_code ORDER BY {LOOP_SCORE}, c.rank) FILTER (c.t_us IS NOT NULL), 0) AS BIGINT) AS source_code,
    t.ref AS ref_before
  FROM gap_walk t LEFT JOIN cand c ON {LOOP_ON} GROUP BY t.unit, t.cycle, t.method, t.ref""", "gap_walk", "cand")
view("trace", f"""SELECT t.unit, t.cycle, t.method, t.ref - {HALF} AS gate_left, t.ref + {HALF} AS gate_right, count(c.t_us) AS candidates,
    CAST(first(c.t_us ORDER BY {LOOP_SCORE}, c.rank) FILTER (c.t_us IS NOT NULL) AS DOUBLE) AS picked_time,
    CAST(coalesce(first(c.source_code ORDER BY {LOOP_SCORE}, c.rank) FILTER (c.t_us IS NOT NULL), 0) AS BIGINT) AS source_code,
    first(c.rank ORDER BY {LOOP_SCORE}, c.rank) FILTER (c.t_us IS NOT NULL) AS picked_rank, t.ref AS ref_before
  FROM walk t LEFT JOIN cand c ON {LOOP_ON} GROUP BY t.unit, t.cycle, t.method, t.ref""", "walk", "cand")
view("sdec", "SELECT * FROM sinfl0 WHERE cond > 0 AND method IN ('T', 'TW')", "sinfl0")
view("sinfl0", influence("(SELECT * FROM spairs WHERE cond > 0)"), "spairs")
view("sind", planned("sdec"), "sdec", "metric_list")
view("spar", planned_pair("sdec", "T", "TW"), "sdec", "metric_list")
view("scells", f"""SELECT 'INDIVIDUAL' AS kind, cond, method AS scope, {CELL_COLS}, sum_b, positive_units FROM sind
  UNION ALL SELECT 'PAIRED', cond, 'T-TW', {CELL_COLS}, NULL, NULL FROM spar""", "sind", "spar")
