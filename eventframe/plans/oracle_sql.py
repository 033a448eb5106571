"""Oracle SQL for the registered queries (DuckDB dialect, driver tables pre-registered as views).

Each statement recomputes the same relation as the Spark query from the raw tables, written the
plain single-node way (global windows, ``quantile_cont``), so it is an independent check of the
distributed formulation. Floats are rounded to 6 decimals, counts are BIGINT.
"""

from __future__ import annotations

from eventframe.constants import CANDIDATE_K, MAX_JETS, X_DIM
from eventframe.sources.event_view import EVENT_VIEW_SQL

Z = "CAST(0 AS DOUBLE)"


def _ln(x: str) -> str:
    return f"ln(greatest({x}, CAST(1e-6 AS DOUBLE)))"


def _fin(*xs: str) -> str:
    return "coalesce(" + " AND ".join(f"isfinite({x})" for x in xs) + ", false)"


def _tok_select(t: int) -> str:
    xs = {i: Z for i in range(X_DIM)}
    if t == 0:
        valid, v = "1", (Z, Z, Z, Z)
        xs.update({11: _ln("MET_pt"), 12: "sin(MET_phi)", 13: "cos(MET_phi)",
                   14: "CAST(njets_nominal AS DOUBLE)", 15: "dimuon_pt_log"})
        typ = 0
    elif t in (1, 2):
        p = f"mu{t}"
        valid, v = "1", (f"{p}_pt", f"{p}_eta", f"{p}_phi", f"{p}_mass")
        xs.update({0: _ln(v[0]), 1: v[1], 2: f"sin({v[2]})", 3: f"cos({v[2]})", 4: _ln(v[3]), 5: _ln(v[3])})
        typ = 1
    else:
        j = t - 2
        p = [f"jet{j}_{f}_nominal" for f in ("pt", "eta", "phi", "mass", "qgl")]
        ok = f"(CAST(trunc(njets_nominal) AS BIGINT) >= {j} AND {_fin(*p[:4])})"
        valid = f"CASE WHEN {ok} THEN 1 ELSE 0 END"
        v = tuple(f"CASE WHEN {ok} THEN {c} ELSE {Z} END" for c in p[:4])
        body = {0: _ln(p[0]), 1: p[1], 2: f"sin({p[2]})", 3: f"cos({p[2]})", 4: _ln(p[3]),
                8: f"CASE WHEN {_fin(p[4])} THEN {p[4]} ELSE {Z} END"}
        xs.update({i: f"CASE WHEN {ok} THEN {e} ELSE {Z} END" for i, e in body.items()})
        typ = 2
    xcols = ", ".join(f"{xs[i]} AS x{i}" for i in range(X_DIM))
    return (
        f"SELECT event_id, y, idx, fold, split, dimuon_mass, {t} AS tok, {typ} AS type, {valid} AS valid, "
        f"{v[0]} AS pt, {v[1]} AS eta, {v[2]} AS phi, {v[3]} AS mass, {xcols} FROM ev_split"
    )


_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, deps: tuple[str, ...], body: str) -> None:
    _CTES[name] = (deps, body)


_cte("v_event", (), EVENT_VIEW_SQL.strip())
_cte("ev_win", ("v_event",),
     "ev_win AS (SELECT * FROM v_event WHERE CAST(dimuon_mass AS FLOAT) >= CAST(115 AS FLOAT) "
     "AND CAST(dimuon_mass AS FLOAT) <= CAST(135 AS FLOAT))")
_cte("ev_idx", ("ev_win",),
     "ev_idx AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY event_id) - 1 AS idx FROM ev_win)")
_cte("ev_fold", ("ev_idx",), "ev_fold AS (SELECT *, CAST(idx % 4 AS INTEGER) AS fold FROM ev_idx)")
_cte("ev_split", ("ev_fold",),
     "ev_split AS (SELECT f.*, s.split FROM ev_fold f JOIN "
     "(VALUES (0, 'train'), (1, 'train'), (2, 'val'), (3, 'test')) AS s(sfold, split) ON f.fold = s.sfold)")
_cte("tok", ("ev_split",), "tok AS (" + "\nUNION ALL\n".join(_tok_select(t) for t in range(7)) + ")")
_scaler_aggs = ", ".join(
    f"coalesce(avg(x{i}), {Z}) AS m{i}, "
    f"CASE WHEN coalesce(stddev_pop(x{i}), {Z}) < CAST(1e-6 AS DOUBLE) THEN CAST(1 AS DOUBLE) "
    f"ELSE stddev_pop(x{i}) END AS s{i}"
    for i in range(X_DIM)
)
_cte("scaler", ("tok",), f"scaler AS (SELECT {_scaler_aggs} FROM tok WHERE split = 'train' AND valid = 1)")


def with_ctes(*names: str) -> str:
    """``WITH`` clause holding ``names`` and everything they depend on, in dependency order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    # steps that several others read run once
    body = lambda n: _CTES[n][1].replace(f"{n} AS (", f"{n} AS MATERIALIZED (", 1) if n in ("tok", "scaler", "p4") else _CTES[n][1]
    return "WITH " + ",\n".join(map(body, order)) + "\n"


def _r(expr: str, alias: str) -> str:
    return f"round({expr}, 6) AS {alias}"


ORACLE: dict[str, str] = {}

ORACLE["mass_window_half_open"] = with_ctes("v_event") + (
    "SELECT event_id, y, round(dimuon_mass, 6) AS dimuon_mass FROM v_event "
    "WHERE dimuon_mass >= 115 AND dimuon_mass < 135"
)
ORACLE["mass_window_closed_f32"] = with_ctes("ev_win") + (
    "SELECT event_id, y, round(dimuon_mass, 6) AS dimuon_mass FROM ev_win"
)
ORACLE["labelled_union"] = with_ctes("v_event") + (
    "SELECT event_id, y, CASE y WHEN 0 THEN 'ggH' WHEN 1 THEN 'VBF' ELSE 'DY' END AS source, "
    "round(dimuon_mass, 6) AS dimuon_mass FROM v_event"
)


def _nan_counts_sql() -> str:
    from eventframe.constants import EVENT_COLUMNS

    parts = [
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS n_missing FROM v_event"
        for c in EVENT_COLUMNS
    ]
    return with_ctes("v_event") + "\nUNION ALL\n".join(parts)


ORACLE["null_nan_normalise"] = _nan_counts_sql()
ORACLE["fold_split_counts"] = with_ctes("ev_split") + (
    "SELECT y, split, count(*) AS n FROM ev_split GROUP BY y, split"
)
ORACLE["fold_rows"] = with_ctes("ev_fold") + "SELECT event_id, y, idx, fold FROM ev_fold"
ORACLE["class_counts"] = with_ctes("ev_win") + (
    "SELECT y, n, CAST(coalesce(sum(n) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
    "AS BIGINT) AS class_offset, CAST(sum(n) OVER () AS BIGINT) AS n_total "
    "FROM (SELECT y, count(*) AS n FROM ev_win GROUP BY y) c"
)
ORACLE["global_ids"] = with_ctes("ev_idx") + (
    "SELECT e.event_id, e.y, CAST(o.off + e.idx AS BIGINT) AS gid FROM ev_idx e JOIN "
    "(SELECT y, coalesce(sum(n) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off "
    " FROM (SELECT y, count(*) AS n FROM ev_idx GROUP BY y) c) o ON e.y = o.y"
)
_xr = ", ".join(f"round(x{i}, 6) AS x{i}" for i in range(X_DIM))
ORACLE["tokens_long"] = with_ctes("tok") + (
    f"SELECT event_id, tok, type, valid, round(pt, 6) AS pt, round(eta, 6) AS eta, round(phi, 6) AS phi, "
    f"round(mass, 6) AS mass, {_xr} FROM tok"
)
ORACLE["token_mask_counts"] = with_ctes("tok") + (
    "SELECT tok, type, count(*) FILTER (WHERE valid = 1) AS n_valid, count(*) FILTER (WHERE valid = 0) AS n_pad "
    "FROM tok GROUP BY tok, type"
)


def _jet_validity_sql() -> str:
    parts = []
    for j in range(1, MAX_JETS + 1):
        p = [f"jet{j}_{f}_nominal" for f in ("pt", "eta", "phi", "mass", "qgl")]
        gate = f"CAST(trunc(njets_nominal) AS BIGINT) >= {j}"
        fin = _fin(*p[:4])
        parts.append(
            f"SELECT {j} AS jet, count(*) FILTER (WHERE {gate}) AS n_gate, count(*) FILTER (WHERE {fin}) AS n_finite, "
            f"count(*) FILTER (WHERE {gate} AND {fin}) AS n_valid, "
            f"count(*) FILTER (WHERE {gate} AND {fin} AND {_fin(p[4])}) AS n_qgl FROM ev_win"
        )
    return with_ctes("ev_win") + "\nUNION ALL\n".join(parts)


ORACLE["jet_validity"] = _jet_validity_sql()
ORACLE["masked_scaler"] = with_ctes("scaler") + "\nUNION ALL\n".join(
    f"SELECT {i} AS feature, round(m{i}, 6) AS mean, round(s{i}, 6) AS std FROM scaler" for i in range(X_DIM)
)
_xs = ", ".join(f"round((t.x{i} - s.m{i}) / s.s{i}, 6) AS xs{i}" for i in range(X_DIM))
ORACLE["scaled_features"] = with_ctes("tok", "scaler") + (
    f"SELECT t.event_id, t.tok, t.valid, {_xs} FROM tok t CROSS JOIN scaler s"
)

# a fixed model over the features, kinematics and mask of an event's tokens
_zs = ", ".join("sum(CASE WHEN t.valid = 1 THEN " + " + ".join(f"(t.x{i} - s.m{i}) / s.s{i}" for i in range(c, X_DIM, 3))
                + f" + 0.01 * t.{('pt', 'eta', 'phi')[c]} ELSE {Z} END) AS z{c}" for c in range(3))
ORACLE["event_score"] = with_ctes("tok", "scaler") + f"""
, z AS (SELECT t.event_id, any_value(f.y) AS y, any_value(t.dimuon_mass) AS dimuon_mass, {_zs}
        FROM tok t CROSS JOIN scaler s JOIN ev_split f ON f.event_id = t.event_id WHERE t.split = 'test' GROUP BY t.event_id),
e AS (SELECT *, greatest(z0, z1, z2) AS mx FROM z),
x AS (SELECT *, exp(z0 - mx) AS e0, exp(z1 - mx) AS e1, exp(z2 - mx) AS e2 FROM e)
SELECT event_id, y, round(dimuon_mass, 6) AS dimuon_mass, {", ".join(f"round(e{c} / (e0 + e1 + e2), 6) AS p{c}" for c in range(3))} FROM x"""

# ---------------------------------------------------------------- sampling
_MD5 = "md5(concat_ws(':', {}))"


def _hint(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 12)) AS BIGINT)"


def _sample_n_sql(n: int) -> str:
    return with_ctes("v_event") + (
        "SELECT event_id, y FROM (SELECT event_id, y, row_number() OVER (PARTITION BY y ORDER BY "
        "md5(concat_ws(':', 42, event_id)), event_id) AS rn FROM v_event "
        f"WHERE dimuon_mass >= 115 AND dimuon_mass < 135) s WHERE rn <= {n}"
    )


ORACLE["sample_exact_n"] = _sample_n_sql(1000)
ORACLE["sample_short_source"] = _sample_n_sql(2250)
_cte("pool", ("ev_split",),
     "pool AS (SELECT event_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws(':', 42, event_id)), "
     "event_id) - 1 AS rnk FROM ev_split WHERE split = 'train')")
_cte("sizes", ("pool",), "sizes AS (SELECT y, count(*) AS n FROM pool GROUP BY y)")


def _batches_sql(k_expr: str, steps_expr: str) -> str:
    return with_ctes("pool", "sizes") + f"""
, par AS (SELECT {k_expr} AS k, {steps_expr} AS steps FROM sizes),
draws AS (SELECT s.y, s.n, p.k, unnest(range(p.k * p.steps)) AS id FROM sizes s, par p),
d2 AS (SELECT y, n, k, id // k AS step, id % k AS draw FROM draws),
tg AS (SELECT y, step, draw, CASE WHEN n >= k THEN (step * k + draw) % n
        ELSE {_hint('42', 'step', 'y', 'draw')} % n END AS rnk FROM d2)
SELECT tg.step, tg.y, tg.draw, pool.event_id, md5(concat_ws(':', 42, tg.step, tg.y, tg.draw)) AS shuffle_key
FROM tg JOIN pool ON tg.y = pool.y AND tg.rnk = pool.rnk"""


ORACLE["balanced_sample"] = _batches_sql("min(n)", "1")
ORACLE["balanced_with_replacement"] = _batches_sql("max(n)", "1")
ORACLE["balanced_steps"] = _batches_sql("768 // 3", "CAST(ceil(3 * max(n) / 768) AS BIGINT)")
# independent draws: four Feistel rounds over a grid of a x b places, walked until the place is below n
def _feistel(x: str, n: str, a: str, b: str, keys: str, table: str) -> str:
    h = lambda i, of: f"CAST(('0x' || substr(md5(concat_ws(':', {keys}, {i}, {of})), 1, 12)) AS BIGINT)"
    s = f"SELECT *, ({x}) // {b} AS l0, ({x}) % {b} AS r0 FROM {table}"
    s = f"SELECT *, (l0 + {h(1, 'r0')}) % {a} AS l1 FROM ({s})"
    s = f"SELECT *, (r0 + {h(2, 'l1')}) % {b} AS r1 FROM ({s})"
    s = f"SELECT *, (l1 + {h(3, 'r1')}) % {a} AS l2 FROM ({s})"
    s = f"SELECT *, (r1 + {h(4, 'l2')}) % {b} AS r2 FROM ({s})"
    return s


def _walk(name: str, x: str, n: str, a: str, b: str, keys: str, table: str, keep: str) -> str:
    first = _feistel(x, n, a, b, keys, table)
    again = _feistel("place", n, a, b, keys, f"(SELECT * FROM {name} WHERE place >= {n})")
    return (f"{name} AS (SELECT {keep}, l2 * {b} + r2 AS place FROM ({first}) UNION ALL "
            f"SELECT {keep}, l2 * {b} + r2 AS place FROM ({again}))")


_DRAWN = "y, n, k, step, slot, draw, a, b, a2, b2"
ORACLE["independent_steps"] = with_ctes("pool", "sizes").replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, par AS (SELECT CAST(768 // 3 AS BIGINT) AS k, CAST(ceil(3 * max(n) / 768) AS BIGINT) AS steps FROM sizes),
ids AS (SELECT unnest(range(k * 3 * steps)) AS id, k FROM par),
dr AS (SELECT s.y, s.n, i.k, i.id // (3 * i.k) AS step, i.id % (3 * i.k) AS slot, i.id % i.k AS draw FROM ids i JOIN sizes s
       ON s.y = (i.id % (3 * i.k)) // i.k),
g0 AS (SELECT *, CAST(ceil(sqrt(greatest(n, k))) AS BIGINT) AS a, CAST(ceil(sqrt(3 * k)) AS BIGINT) AS a2 FROM dr),
grid AS (SELECT *, CAST(ceil(greatest(n, k) / a) AS BIGINT) AS b, CAST(ceil((3 * k) / a2) AS BIGINT) AS b2 FROM g0),
{_walk("w1", "draw", "greatest(n, k)", "a", "b", "42, step, y", "grid", _DRAWN)},
{_walk("w2", "slot", "(3 * k)", "a2", "b2", "42, step, 'order'", "grid", _DRAWN)},
hit AS (SELECT w1.step, w1.y, w1.draw, w2.place AS pos, CASE WHEN w1.n >= w1.k THEN w1.place
        ELSE {_hint('42', 'w1.step', 'w1.y', 'w1.draw')} % w1.n END AS rnk
        FROM w1 JOIN w2 ON w1.step = w2.step AND w1.slot = w2.slot WHERE w1.place < greatest(w1.n, w1.k) AND w2.place < 3 * w2.k)
SELECT hit.step, hit.pos, hit.y, hit.draw, pool.event_id FROM hit JOIN pool ON hit.y = pool.y AND hit.rnk = pool.rnk"""
ORACLE["gather_rows"] = with_ctes("ev_idx") + f"""
, sz AS (SELECT y, count(*) AS n FROM ev_idx GROUP BY y),
dr AS (SELECT y, n, unnest(range(n)) AS d FROM sz),
pos AS (SELECT y, d, {_hint('7', 'y', 'd')} % n AS idx FROM dr)
SELECT pos.y, pos.d, pos.idx, e.event_id FROM pos JOIN ev_idx e ON pos.y = e.y AND pos.idx = e.idx"""

# ---------------------------------------------------------------- binning
_cte("masses", ("ev_split",),
     "masses AS (SELECT event_id, y, dimuon_mass, CAST(CAST(dimuon_mass AS FLOAT) AS DOUBLE) AS m, "
     "row_number() OVER () AS rid FROM ev_split WHERE split = 'train')")


def _edges_cte(name: str, ks) -> None:
    parts = []
    for k in sorted(set(ks)):
        qs = ", ".join(f"CAST({b} AS DOUBLE) / {k}" for b in range(k + 1))
        parts.append(
            f"SELECT {k} AS K, CAST(t.b AS INTEGER) AS b, CASE WHEN t.b = 0 THEN CAST(115 AS DOUBLE) WHEN t.b = {k} THEN CAST(135 AS DOUBLE) "
            f"ELSE q.q[t.b + 1] END AS edge FROM (SELECT quantile_cont(m, [{qs}]) AS q FROM masses "
            f"WHERE m >= 115 AND m <= 135) q, range({k + 1}) t(b)"
        )
    _cte(name, ("masses",), f"{name} AS (" + "\nUNION ALL\n".join(parts) + ")")


def _hist_cte(name: str, edges: str) -> None:
    _cte(name, (edges,), f"""{name} AS (
  SELECT g.K, g.b, coalesce(h.n, 0) AS n FROM (SELECT K, b FROM {edges} WHERE b < K) g LEFT JOIN (
    SELECT K, b, count(*) AS n FROM (
      SELECT e.K, mm.rid, least(count(*) - 1, e.K - 1) AS b FROM masses mm JOIN {edges} e ON e.edge <= mm.m
      WHERE mm.m >= 115 AND mm.m <= 135 GROUP BY e.K, mm.rid) x GROUP BY K, b) h ON g.K = h.K AND g.b = h.b)""")


_edges_cte("edges", CANDIDATE_K)
_hist_cte("hist", "edges")
_edges_cte("edges_fb", [1] + list(CANDIDATE_K))
_hist_cte("hist_fb", "edges_fb")
_cte("chosen", ("hist",), "chosen AS (SELECT coalesce((SELECT max(K) FROM (SELECT K, min(n) AS mn FROM hist "
     "GROUP BY K) s WHERE K >= 2 AND mn >= 500), (SELECT min(K) FROM hist)) AS K)")
_cte("chosen_fb", ("hist_fb",), "chosen_fb AS (SELECT coalesce((SELECT max(K) FROM (SELECT K, min(n) AS mn "
     "FROM hist_fb GROUP BY K) s WHERE K >= 2 AND mn >= (SELECT count(*) FROM masses)), "
     "(SELECT min(K) FROM hist_fb)) AS K)")

ORACLE["equal_freq_edges"] = with_ctes("edges") + "SELECT K, b, round(edge, 6) AS edge FROM edges"
ORACLE["edge_histogram"] = with_ctes("hist") + "SELECT K, b, CAST(n AS BIGINT) AS n FROM hist"
ORACLE["choose_k"] = with_ctes("edges", "chosen") + (
    "SELECT e.K, e.b, round(CAST(CAST(e.edge AS FLOAT) AS DOUBLE), 6) AS edge FROM edges e JOIN chosen c ON e.K = c.K"
)
ORACLE["choose_k_fallback"] = with_ctes("edges_fb", "chosen_fb") + (
    "SELECT e.K, e.b, round(CAST(CAST(e.edge AS FLOAT) AS DOUBLE), 6) AS edge FROM edges_fb e "
    "JOIN chosen_fb c ON e.K = c.K"
)
_cte("mbin", ("edges", "chosen"), """mbin AS (
  SELECT mm.event_id, mm.y, CAST(greatest(0, least(max(ce.K) - 1,
         count(ce.ef) FILTER (WHERE ce.ef < CAST(mm.dimuon_mass AS FLOAT)) - 1)) AS INTEGER) AS mass_bin
  FROM masses mm, (SELECT e.K, CAST(e.edge AS FLOAT) AS ef FROM edges e JOIN chosen c ON e.K = c.K) ce
  GROUP BY mm.event_id, mm.y)""")
ORACLE["mass_bin_assign"] = with_ctes("mbin") + "SELECT event_id, y, mass_bin FROM mbin"

# ---------------------------------------------------------------- pairs
_PI = "pi()"
_cte("p4", ("tok",), """p4 AS (SELECT event_id, tok, type, valid, pt, eta, phi, mass,
  sqrt(greatest(mass * mass + (pt * cos(phi) * (pt * cos(phi)) + pt * sin(phi) * (pt * sin(phi))
       + pt * sinh(eta) * (pt * sinh(eta))), 0)) AS E,
  pt * cos(phi) AS px, pt * sin(phi) AS py, pt * sinh(eta) AS pz FROM tok)""")
_DPHI_RAW = f"(a.phi - b.phi + {_PI})"
_FM = f"fmod({_DPHI_RAW}, 2 * {_PI})"
_DPHI = f"(CASE WHEN {_FM} < 0 THEN fmod({_FM} + 2 * {_PI}, 2 * {_PI}) ELSE {_FM} END - {_PI})"
_cte("pairs", ("p4",), f"""pairs AS (SELECT a.event_id, a.tok AS i, b.tok AS j, a.valid AS valid_i, b.valid AS valid_j,
  a.type AS type_i, b.type AS type_j,
  a.eta - b.eta AS deta, sin({_DPHI}) AS sin_dphi, cos({_DPHI}) AS cos_dphi,
  ln(greatest(sqrt(greatest((a.eta - b.eta) * (a.eta - b.eta) + {_DPHI} * {_DPHI}, 0)), CAST(1e-6 AS DOUBLE))) AS log_dr,
  ln(greatest(a.pt + CAST(1e-6 AS DOUBLE), CAST(1e-6 AS DOUBLE))) - ln(greatest(b.pt + CAST(1e-6 AS DOUBLE), CAST(1e-6 AS DOUBLE))) AS log_pt_ratio,
  sqrt(greatest((a.E + b.E) * (a.E + b.E) - ((a.px + b.px) * (a.px + b.px) + (a.py + b.py) * (a.py + b.py)
       + (a.pz + b.pz) * (a.pz + b.pz)), 0)) AS mij
  FROM p4 a JOIN p4 b ON a.event_id = b.event_id)""")
ORACLE["pair_features"] = with_ctes("pairs") + """SELECT event_id, i, j, valid_i, valid_j, round(deta, 6) AS deta,
  round(sin_dphi, 6) AS sin_dphi, round(cos_dphi, 6) AS cos_dphi, round(log_dr, 6) AS log_dr,
  round(log_pt_ratio, 6) AS log_pt_ratio,
  round(CASE WHEN type_i = 2 AND type_j = 2 THEN ln(greatest(mij, CAST(1e-6 AS DOUBLE))) ELSE CAST(0 AS DOUBLE) END, 6) AS log_mjj
FROM pairs"""
ORACLE["pair_mass_jets"] = with_ctes("pairs") + (
    "SELECT event_id, i, j, round(mij, 6) AS mij FROM pairs WHERE i >= 3 AND j >= 3 AND valid_i = 1 AND valid_j = 1"
)
ORACLE["pair_valid_keys"] = with_ctes("pairs") + (
    "SELECT i, j, count(*) AS n_valid_key, count(*) FILTER (WHERE valid_i = 1) AS n_both FROM pairs "
    "WHERE valid_j = 1 GROUP BY i, j"
)

# ---------------------------------------------------------------- scores, losses, metrics
_D = "CAST({} AS DOUBLE)"


def _scored_ctes(prefix: str, source: str, z1: str = "z1r") -> str:
    """CTE bodies producing p0..p2, ce and pred from logits z0, z1, z2."""
    return f"""{prefix}_m AS (SELECT *, greatest(z0, {z1}, z2) AS mx FROM {source}),
{prefix}_e AS (SELECT *, exp(z0 - mx) AS e0, exp({z1} - mx) AS e1, exp(z2 - mx) AS e2 FROM {prefix}_m),
{prefix}_p AS (SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1,
    e2 / (e0 + e1 + e2) AS p2,
    mx + ln(e0 + e1 + e2) - CASE y WHEN 0 THEN z0 WHEN 1 THEN {z1} ELSE z2 END AS ce FROM {prefix}_e),
{prefix} AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred FROM {prefix}_p)"""


_cte("sc_z", ("ev_split",), """sc_z AS (SELECT event_id, y, idx, split, dimuon_mass AS mass, MET_phi,
    MET_pt / 200 AS z0, mu1_pt / 20 AS z1r, CAST(njets_nominal AS DOUBLE) / 3 AS z2 FROM ev_split)""")
_cte("sc_all", ("sc_z",), _scored_ctes("sc_all", "sc_z"))
_cte("scored", ("sc_all",), "scored AS (SELECT * FROM sc_all WHERE split = 'test')")
_cte("dy", ("scored",), "dy AS (SELECT 1 - p2 AS s, mass FROM scored WHERE y = 2)")


def _auc_sql(src: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group}, c" if group else "PARTITION BY c"
    ex = "\nUNION ALL\n".join(
        f"SELECT {g}{c} AS c, p{c} AS s, CASE WHEN y = {c} THEN 1 ELSE 0 END AS pos FROM {src}" for c in range(3)
    )
    return f"""ex AS ({ex}),
ag AS (SELECT {g}c, s, CAST(sum(pos) AS DOUBLE) AS P, CAST(sum(1 - pos) AS DOUBLE) AS N FROM ex GROUP BY {g}c, s),
cu AS (SELECT *, coalesce(sum(N) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS N_below,
              coalesce(sum(P) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS P_below
       FROM ag),
tot AS (SELECT {g}c, sum(P) AS Pt, sum(N) AS Nt, sum(P * (N_below + N / 2)) AS num FROM cu GROUP BY {g}c)"""


ORACLE["softmax_argmax"] = with_ctes("scored") + "SELECT event_id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, pred FROM scored"
ORACLE["cross_entropy"] = with_ctes("scored") + "SELECT event_id, y, round(ce, 6) AS ce FROM scored"
_BATCH = """
, v AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY idx) - 1 AS pos FROM {src}),
off AS (SELECT y, coalesce(sum(n) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
        FROM (SELECT y, count(*) AS n FROM v GROUP BY y) c),
g AS (SELECT v.*, off.off + v.pos AS gid FROM v JOIN off ON v.y = off.y)"""
ORACLE["batch_mean_loss"] = with_ctes("sc_all") + _BATCH.format(src="sc_all WHERE split = 'val'") + """
, b AS (SELECT floor(gid / 2048) AS batch, avg(ce) AS bm, sum(ce) AS bs, count(*) AS bn FROM g GROUP BY 1)
SELECT round(avg(bm), 6) AS loss_mean_of_batches, round(sum(bs) / sum(bn), 6) AS loss_row_weighted,
       count(*) AS n_batches, CAST(sum(bn) AS BIGINT) AS n FROM b"""
ORACLE["batch_mean_small"] = with_ctes("sc_all") + _BATCH.format(src="sc_all WHERE split = 'val'") + """
, b AS (SELECT floor(gid / 100) AS batch, avg(ce) AS bm, sum(ce) AS bs, count(*) AS bn FROM g GROUP BY 1)
SELECT round(avg(bm), 6) AS loss_mean_of_batches, round(sum(bs) / sum(bn), 6) AS loss_row_weighted,
       count(*) AS n_batches, CAST(sum(bn) AS BIGINT) AS n FROM b"""
ORACLE["mass_bin_cross_entropy"] = with_ctes("sc_all", "mbin", "chosen") + """
, tr AS (SELECT s.event_id, s.ce, s.MET_phi, mb.mass_bin FROM sc_all s JOIN mbin mb ON s.event_id = mb.event_id
         WHERE s.split = 'train'),
ak AS (SELECT tr.event_id, tr.mass_bin, unnest(range(c.K)) AS k, tr.MET_phi FROM tr, chosen c),
az AS (SELECT event_id, mass_bin, k, sin(CAST(k + 1 AS DOUBLE) * MET_phi) AS zk FROM ak),
am AS (SELECT event_id, max(zk) AS mx FROM az GROUP BY event_id),
adv AS (SELECT az.event_id, am.mx + ln(sum(exp(az.zk - am.mx))) - max(CASE WHEN az.k = az.mass_bin THEN az.zk END) AS ce_adv
        FROM az JOIN am ON az.event_id = am.event_id GROUP BY az.event_id, am.mx),
agg AS (SELECT count(*) AS n, avg(tr.ce) AS loss_cls, avg(adv.ce_adv) AS loss_adv FROM tr JOIN adv ON tr.event_id = adv.event_id)
SELECT c.K, agg.n, round(loss_cls, 6) AS loss_cls, round(loss_adv, 6) AS loss_adv, round(loss_cls + loss_adv, 6) AS loss,
       round(ln(CAST(c.K AS DOUBLE)), 6) AS chance FROM agg, chosen c"""
ORACLE["accuracy"] = with_ctes("scored") + (
    "SELECT round(coalesce(avg(CASE WHEN y = pred THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 0), 6) "
    "AS accuracy, count(*) AS n FROM scored"
)
ORACLE["confusion_matrix"] = with_ctes("scored") + """SELECT g.y, g.pred, coalesce(c.n, 0) AS n FROM
  (SELECT CAST(a.y AS INTEGER) AS y, CAST(b.pred AS INTEGER) AS pred FROM range(3) a(y), range(3) b(pred)) g
  LEFT JOIN (SELECT y, pred, count(*) AS n FROM scored GROUP BY y, pred) c ON g.y = c.y AND g.pred = c.pred"""
ORACLE["auc_ovr"] = with_ctes("scored") + ", " + _auc_sql("scored") + """
SELECT CAST(c AS INTEGER) AS class, round(CASE WHEN Pt > 0 AND Nt > 0 THEN num / (Pt * Nt) END, 6) AS auc FROM tot"""
ORACLE["auc_degenerate"] = with_ctes("scored") + ", sc1 AS (SELECT * FROM scored WHERE y <> 1), " + _auc_sql("sc1") + """
SELECT CAST(c AS INTEGER) AS class, round(CASE WHEN Pt > 0 AND Nt > 0 THEN num / (Pt * Nt) END, 6) AS auc FROM tot"""
ORACLE["auc_ties"] = with_ctes("scored") + """, ex AS (
""" + "\nUNION ALL\n".join(f"SELECT {c} AS c, round(p{c}, 2) AS s, y = {c} AS pos FROM scored" for c in range(3)) + """),
pairs AS (SELECT a.c, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END::DOUBLE) AS auc
          FROM ex a JOIN ex b ON a.c = b.c AND a.pos AND NOT b.pos GROUP BY a.c)
SELECT CAST(c AS INTEGER) AS class, round(auc, 6) AS auc FROM pairs"""
ORACLE["roc_points"] = with_ctes("scored") + ", " + _auc_sql("scored") + """
SELECT CAST(cu.c AS INTEGER) AS class, round(cu.s, 6) AS threshold, round((t.Nt - cu.N_below) / t.Nt, 6) AS fpr,
       round((t.Pt - cu.P_below) / t.Pt, 6) AS tpr
FROM cu JOIN tot t ON cu.c = t.c WHERE t.Pt > 0 AND t.Nt > 0
UNION ALL
SELECT CAST(c AS INTEGER), CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM tot WHERE Pt > 0 AND Nt > 0"""
ORACLE["roc_trapezoid"] = with_ctes("scored") + ", " + _auc_sql("scored") + """
SELECT CAST(cu.c AS INTEGER) AS class, round(sum(cu.N * (2 * (t.Pt - cu.P_below) - cu.P)) / (2 * max(t.Pt) * max(t.Nt)), 6) AS auc_trapz
FROM cu JOIN tot t ON cu.c = t.c WHERE t.Pt > 0 AND t.Nt > 0 GROUP BY cu.c"""
ORACLE["top_decile_purity"] = with_ctes("scored") + """
, th AS (SELECT quantile_cont(p1, CAST(0.9 AS DOUBLE)) AS thr FROM scored)
SELECT round(max(th.thr), 6) AS threshold, count(*) AS n_selected,
       round(avg(CASE WHEN y = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS purity
FROM scored, th WHERE p1 >= th.thr"""
ORACLE["pearson_guarded"] = with_ctes("dy") + """
SELECT count(*) AS n, round(stddev_pop(s), 6) AS std_s, round(stddev_pop(mass), 6) AS std_m, round(min(s), 6) AS min_s,
  round(max(s), 6) AS max_s,
  round(CASE WHEN stddev_pop(s) < 1e-12 OR stddev_pop(mass) < 1e-12 THEN NULL
        ELSE covar_pop(s, mass) / (stddev_pop(s) * stddev_pop(mass)) END, 6) AS r FROM dy"""
_qs6 = ", ".join(f"CAST({i} AS DOUBLE) / 6" for i in range(7))
_cte("sedges", ("dy",), f"""sedges AS (SELECT min(s) AS e0, q[2] AS e1, q[3] AS e2, q[4] AS e3, q[5] AS e4, q[6] AS e5,
    max(s) AS e6 FROM (SELECT quantile_cont(s, [{_qs6}]) AS q, min(s) AS s0 FROM dy) qq, dy GROUP BY q)""")
_cte("dyb", ("sedges",), """dyb AS (SELECT dy.s, dy.mass, (CASE WHEN e.e1 <= dy.s THEN 1 ELSE 0 END + CASE WHEN e.e2 <= dy.s THEN 1 ELSE 0 END
    + CASE WHEN e.e3 <= dy.s THEN 1 ELSE 0 END + CASE WHEN e.e4 <= dy.s THEN 1 ELSE 0 END
    + CASE WHEN e.e5 <= dy.s THEN 1 ELSE 0 END) AS bin FROM dy, sedges e)""")
ORACLE["score_bins"] = with_ctes("sedges", "dyb") + """
, grid AS (SELECT 0 AS bin, e0 AS lo, e1 AS hi FROM sedges UNION ALL SELECT 1, e1, e2 FROM sedges
   UNION ALL SELECT 2, e2, e3 FROM sedges UNION ALL SELECT 3, e3, e4 FROM sedges
   UNION ALL SELECT 4, e4, e5 FROM sedges UNION ALL SELECT 5, e5, e6 FROM sedges)
SELECT g.bin, round(g.lo, 6) AS lo, round(g.hi, 6) AS hi, coalesce(c.n, 0) AS n FROM grid g
LEFT JOIN (SELECT bin, count(*) AS n FROM dyb GROUP BY bin) c ON g.bin = c.bin"""
ORACLE["score_bin_mass_hist"] = with_ctes("dyb") + """
, rg AS (SELECT bin, CASE WHEN min(mass) = max(mass) THEN min(mass) - 0.5 ELSE min(mass) END AS lo,
               CASE WHEN min(mass) = max(mass) THEN max(mass) + 0.5 ELSE max(mass) END AS hi FROM dyb GROUP BY bin),
h0 AS (SELECT d.bin, d.mass AS m, r.lo, r.hi, (r.hi - r.lo) / 40 AS step,
        floor((d.mass - r.lo) / (r.hi - r.lo) * 40) AS i0 FROM dyb d JOIN rg r ON d.bin = r.bin),
h1 AS (SELECT *, CASE WHEN i0 = 40 THEN 39 ELSE i0 END AS ia FROM h0),
h2 AS (SELECT *, CASE WHEN m < (CASE WHEN ia >= 40 THEN hi ELSE ia * step + lo END) THEN ia - 1 ELSE ia END AS ib FROM h1),
h3 AS (SELECT *, CASE WHEN ib <> 39 AND m >= (CASE WHEN ib + 1 >= 40 THEN hi ELSE (ib + 1) * step + lo END)
        THEN ib + 1 ELSE ib END AS h FROM h2)
SELECT g.bin, g.h, coalesce(c.n, 0) AS n FROM (SELECT CAST(a.bin AS INTEGER) AS bin, CAST(b.h AS INTEGER) AS h
  FROM range(6) a(bin), range(40) b(h)) g
LEFT JOIN (SELECT bin, CAST(h AS INTEGER) AS h, count(*) AS n FROM h3 GROUP BY 1, 2) c ON g.bin = c.bin AND g.h = c.h"""
ORACLE["eval_report"] = with_ctes("scored", "dy") + ", " + _auc_sql("scored") + """
, th AS (SELECT quantile_cont(p1, CAST(0.9 AS DOUBLE)) AS thr FROM scored),
pu AS (SELECT avg(CASE WHEN y = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS purity FROM scored, th WHERE p1 >= th.thr),
pr AS (SELECT CASE WHEN stddev_pop(s) < 1e-12 OR stddev_pop(mass) < 1e-12 THEN NULL
        ELSE covar_pop(s, mass) / (stddev_pop(s) * stddev_pop(mass)) END AS r FROM dy),
ac AS (SELECT coalesce(avg(CASE WHEN y = pred THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 0) AS acc, count(*) AS n FROM scored),
au AS (SELECT max(CASE WHEN c = 0 THEN num / (Pt * Nt) END) AS a0, max(CASE WHEN c = 1 THEN num / (Pt * Nt) END) AS a1,
              max(CASE WHEN c = 2 THEN num / (Pt * Nt) END) AS a2 FROM tot WHERE Pt > 0 AND Nt > 0)
SELECT round(ac.acc, 6) AS test_accuracy, round(au.a0, 6) AS auc_0, round(au.a1, 6) AS auc_1, round(au.a2, 6) AS auc_2,
       round(pu.purity, 6) AS vbf_purity_top10pct, round(pr.r, 6) AS dy_mass_sculpting_pearson_r, ac.n AS n_test
FROM ac, au, pu, pr"""
ORACLE["epoch_eval"] = with_ctes("sc_z") + """
, ez AS (SELECT s.*, e.epoch, s.z1r * (CAST(1 AS DOUBLE) + CAST(0.2 AS DOUBLE) * e.epoch) AS z1e
         FROM sc_z s, (SELECT CAST(range AS INTEGER) AS epoch FROM range(5)) e WHERE s.split = 'val'),
""" + _scored_ctes("es", "ez", z1="z1e") + """
, v AS (SELECT *, row_number() OVER (PARTITION BY epoch, y ORDER BY idx) - 1 AS pos FROM es),
off AS (SELECT epoch, y, coalesce(sum(n) OVER (PARTITION BY epoch ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
        FROM (SELECT epoch, y, count(*) AS n FROM v GROUP BY epoch, y) c),
g AS (SELECT v.*, off.off + v.pos AS gid FROM v JOIN off ON v.y = off.y AND v.epoch = off.epoch),
lo AS (SELECT epoch, avg(bm) AS loss FROM (SELECT epoch, floor(gid / 2048) AS b, avg(ce) AS bm FROM g GROUP BY 1, 2) x GROUP BY epoch),
acc AS (SELECT epoch, coalesce(avg(CASE WHEN y = pred THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 0) AS accuracy FROM es GROUP BY epoch),
""" + _auc_sql("es", "epoch") + """
, au AS (SELECT epoch, max(CASE WHEN c = 0 AND Pt > 0 AND Nt > 0 THEN num / (Pt * Nt) END) AS a0,
              max(CASE WHEN c = 1 AND Pt > 0 AND Nt > 0 THEN num / (Pt * Nt) END) AS a1,
              max(CASE WHEN c = 2 AND Pt > 0 AND Nt > 0 THEN num / (Pt * Nt) END) AS a2 FROM tot GROUP BY epoch)
SELECT lo.epoch, round(lo.loss, 6) AS loss, round(acc.accuracy, 6) AS accuracy, round(au.a0, 6) AS auc_0,
       round(au.a1, 6) AS auc_1, round(au.a2, 6) AS auc_2
FROM lo JOIN acc ON lo.epoch = acc.epoch JOIN au ON lo.epoch = au.epoch"""

# ---------------------------------------------------------------- run history
_HIST = ("hist AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch, "
         "value AS loss, event_type FROM events)")
ORACLE["early_stopping"] = "WITH RECURSIVE " + _HIST + """,
st(run, epoch, best, best_epoch, bad, stop) AS (
  SELECT run, epoch, loss, epoch, 0, CAST(NULL AS BIGINT) FROM hist WHERE epoch = 0
  UNION ALL
  SELECT h.run, h.epoch,
    CASE WHEN h.loss < st.best - CAST(1e-4 AS DOUBLE) THEN h.loss ELSE st.best END,
    CASE WHEN h.loss < st.best - CAST(1e-4 AS DOUBLE) THEN h.epoch ELSE st.best_epoch END,
    CASE WHEN h.loss < st.best - CAST(1e-4 AS DOUBLE) THEN 0 ELSE st.bad + 1 END,
    CASE WHEN NOT (h.loss < st.best - CAST(1e-4 AS DOUBLE)) AND st.bad + 1 >= 8 THEN h.epoch END
  FROM st JOIN hist h ON h.run = st.run AND h.epoch = st.epoch + 1 WHERE st.stop IS NULL),
fin AS (SELECT run, max(epoch) AS last FROM st GROUP BY run),
n AS (SELECT run, count(*) AS n_epochs FROM hist GROUP BY run)
SELECT st.run, n.n_epochs, st.best_epoch, round(st.best, 6) AS best_loss, st.stop AS stop_epoch,
       CAST(st.epoch + 1 AS BIGINT) AS epochs_run
FROM st JOIN fin ON st.run = fin.run AND st.epoch = fin.last JOIN n ON st.run = n.run"""
ORACLE["early_stopping_nan"] = ORACLE["early_stopping"].replace(
    "value AS loss", "CASE WHEN event_type = 'error' THEN CAST('nan' AS DOUBLE) ELSE value END AS loss").replace(
    "h.loss < st.best - CAST(1e-4 AS DOUBLE)", "(h.loss < st.best - CAST(1e-4 AS DOUBLE) AND NOT isnan(st.best))").replace(
    "round(st.best, 6) AS best_loss", "CASE WHEN NOT isnan(st.best) THEN round(st.best, 6) END AS best_loss")
ORACLE["best_epoch"] = "WITH " + _HIST + """,
pm AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
       FROM hist)
SELECT run, max(epoch) AS best_epoch, round(arg_max(loss, epoch), 6) AS best_loss FROM pm
WHERE pm IS NULL OR loss <= pm GROUP BY run"""
ORACLE["lambda_schedule"] = "WITH " + _HIST + """
SELECT epoch, round(CAST(0.5 AS DOUBLE) * least(CAST(1 AS DOUBLE), CAST(epoch + 1 AS DOUBLE) / CAST(5 AS DOUBLE)), 6)
       AS lambda_grl FROM (SELECT DISTINCT epoch FROM hist) e"""
_STEPS = "steps_ AS (SELECT run, CAST(floor(epoch / 4) AS BIGINT) AS epoch, loss, event_type FROM hist)"
ORACLE["epoch_means"] = "WITH " + _HIST + ", " + _STEPS + """
SELECT run, epoch, round(avg(CASE WHEN event_type <> 'error' THEN loss END), 6) AS loss,
       round(avg(CASE WHEN event_type <> 'error' THEN loss * CAST(0.75 AS DOUBLE) END), 6) AS loss_cls,
       round(avg(CASE WHEN event_type <> 'error' THEN loss * CAST(0.25 AS DOUBLE) END), 6) AS loss_adv,
       count(*) FILTER (WHERE event_type <> 'error') AS steps FROM steps_ GROUP BY run, epoch"""
ORACLE["stop_truncation"] = ORACLE["early_stopping"].replace(
    """SELECT st.run, n.n_epochs, st.best_epoch, round(st.best, 6) AS best_loss, st.stop AS stop_epoch,
       CAST(st.epoch + 1 AS BIGINT) AS epochs_run
FROM st JOIN fin ON st.run = fin.run AND st.epoch = fin.last JOIN n ON st.run = n.run""",
    """, stops AS (SELECT st.run, st.stop FROM st JOIN fin ON st.run = fin.run AND st.epoch = fin.last)
SELECT h.run, count(*) AS n_kept, max(h.epoch) AS last_epoch FROM hist h JOIN stops s ON h.run = s.run
WHERE s.stop IS NULL OR h.epoch <= s.stop GROUP BY h.run""")
ORACLE["history_table"] = "WITH " + _HIST + ", " + _STEPS + """
SELECT CAST(run AS VARCHAR) AS run_id, 'train' AS part, epoch, round(avg(CASE WHEN event_type <> 'error' THEN loss END), 6) AS loss,
       round(avg(CASE WHEN event_type <> 'error' THEN loss * CAST(0.75 AS DOUBLE) END), 6) AS loss_cls,
       round(avg(CASE WHEN event_type <> 'error' THEN loss * CAST(0.25 AS DOUBLE) END), 6) AS loss_adv,
       count(*) FILTER (WHERE event_type <> 'error') AS steps,
       round(CAST(0.5 AS DOUBLE) * least(CAST(1 AS DOUBLE), CAST(epoch + 1 AS DOUBLE) / CAST(5 AS DOUBLE)), 6) AS lambda_grl
FROM steps_ GROUP BY run, epoch
UNION ALL
SELECT CAST(run AS VARCHAR), 'val', epoch, round(max(loss), 6), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
       CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE)
FROM steps_ GROUP BY run, epoch"""

ORACLE["history_replayed"] = ORACLE["history_table"]

# ---------------------------------------------------------------- artefacts
ORACLE["scaler_roundtrip"] = ORACLE["masked_scaler"]
ORACLE["bins_roundtrip"] = ORACLE["choose_k"]
ORACLE["empty_sink"] = with_ctes("v_event") + (
    "SELECT event_id, y, round(dimuon_mass, 6) AS dimuon_mass FROM v_event WHERE dimuon_mass >= 1000 AND dimuon_mass < 1010"
)
ORACLE["metrics_sink"] = ORACLE["eval_report"]

# ---------------------------------------------------------------- training: the equations of the optimum
def _moments(key: str, source: str, mean: str) -> str:
    """Means of the scaled features by class, the intercept as feature -1; ``mean`` takes a value."""
    rows = [f"SELECT {key} AS class, t.tok * 16 + {i} AS feature, {mean.format(f'(t.x{i} - s.m{i}) / s.s{i}')} AS observed "
            f"FROM {source} CROSS JOIN scaler s GROUP BY {key}, t.tok" for i in range(X_DIM)]
    rows.append(f"SELECT {key}, -1, {mean.format('CAST(1 AS DOUBLE)')} FROM {source} WHERE t.tok = 0 GROUP BY {key}")
    return ("SELECT CAST(class AS INTEGER) AS class, CAST(feature AS INTEGER) AS feature, round(observed, 6) AS observed, "
            "true AS met FROM (" + " UNION ALL ".join(rows) + ") r")


ORACLE["train_optimum"] = with_ctes("tok", "scaler") + """
, tr AS (SELECT f.y, t.* EXCLUDE (y) FROM tok t JOIN ev_split f ON f.event_id = t.event_id WHERE t.split = 'train')
""" + _moments("t.y", "tr t", "avg({}) / 3")
ORACLE["probe_optimum"] = with_ctes("tok", "scaler", "mbin") + """
, tr AS (SELECT m.mass_bin, t.* FROM tok t JOIN mbin m ON m.event_id = t.event_id WHERE t.split = 'train')
""" + _moments("t.mass_bin", "tr t", "sum({}) / (SELECT count(*) FROM mbin)")

# ---------------------------------------------------------------- scoring
ORACLE["batch_score"] = "WITH z AS (SELECT vec_id, " + ", ".join(
    f"list_sum(list_transform(range({c}, 64, 3), lambda i: CAST(embedding[i + 1] AS DOUBLE))) AS z{c}" for c in range(3)) + """ FROM embeddings),
e AS (SELECT vec_id, exp(z0 - greatest(z0, z1, z2)) AS e0, exp(z1 - greatest(z0, z1, z2)) AS e1,
    exp(z2 - greatest(z0, z1, z2)) AS e2 FROM z)
SELECT vec_id, round(e0 / (e0 + e1 + e2), 6) AS p0, round(e1 / (e0 + e1 + e2), 6) AS p1, round(e2 / (e0 + e1 + e2), 6) AS p2
FROM e"""

ORACLE["curation_job"] = with_ctes("v_event") + """
SELECT event_id, y, CASE y WHEN 0 THEN 'ggH' WHEN 1 THEN 'VBF' ELSE 'DY' END AS source, round(dimuon_mass, 6) AS dimuon_mass,
       row_number() OVER (PARTITION BY y ORDER BY event_id) - 1 AS pos
FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws(':', 42, event_id)), event_id) AS rn
      FROM v_event WHERE dimuon_mass >= 115 AND dimuon_mass < 135) s WHERE rn <= 1000"""
ORACLE["file_rows"] = """WITH r AS (SELECT l_quantity, row_number() OVER () - 1 AS row_index FROM lineitem),
f AS (SELECT 0 AS y, 0 AS file_ord, * FROM r UNION ALL SELECT 0, 1, * FROM r UNION ALL SELECT 1, 0, * FROM r),
i AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY file_ord, row_index) - 1 AS idx FROM f
      WHERE l_quantity >= 10 AND l_quantity < 40)
SELECT CAST(y AS INTEGER) AS y, CAST(file_ord AS INTEGER) AS file_ord, row_index, idx, CAST(idx % 4 AS INTEGER) AS fold FROM i"""

ORACLE["checked_inputs"] = """SELECT 'ggH' AS source, 'lineitem' AS name, false AS missing, count(*) AS n FROM lineitem
UNION ALL SELECT 'ggH', 'absent_a', true, 0 UNION ALL SELECT 'VBF', 'orders', false, count(*) FROM orders
UNION ALL SELECT 'DY', 'absent_b', true, 0 UNION ALL SELECT 'DY', 'events', false, count(*) FROM events"""
ORACLE["pool_sizes"] = with_ctes("ev_split") + "SELECT y, count(*) AS n FROM ev_split WHERE split = 'train' GROUP BY y"


def _absent_jets_sql() -> str:
    parts = []
    for j in range(1, MAX_JETS + 1):
        ok = f"CAST(trunc(njets_nominal) AS BIGINT) >= {j} AND " + _fin(*[f"jet{j}_{f}_nominal" for f in ("pt", "eta", "phi", "mass")])
        parts.append(f"SELECT {j} AS jet, count(*) FILTER (WHERE {ok if j <= 2 else 'false'}) AS n_valid, count(*) AS n FROM ev_win")
    return with_ctes("ev_win") + "\nUNION ALL\n".join(parts)


ORACLE["absent_jets"] = _absent_jets_sql()
