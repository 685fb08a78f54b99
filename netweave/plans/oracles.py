"""Building blocks of the queries' DuckDB SQL."""

from __future__ import annotations

from netweave.sources.flowview import FLOW_SQL

FLOW = f"f AS ({FLOW_SQL})"
NUMBERED = f"{FLOW}, n AS (SELECT *, row_number() OVER (PARTITION BY pod ORDER BY seq) AS rn, count(*) OVER (PARTITION BY pod) AS total FROM f)"
#: Rows of every window k: complete ones, and -1 for the last 500 rows if rows remain.
HOPPED = f"""{NUMBERED},
h AS (SELECT n.*, CAST(k AS BIGINT) AS k FROM n, LATERAL (SELECT unnest(range(0, 1 + CAST(floor((total - 500) / 250.0) AS BIGINT))) AS k) WHERE rn BETWEEN 1 + 250 * k AND 500 + 250 * k),
t AS (SELECT n.*, CAST(-1 AS BIGINT) AS k FROM n WHERE (CASE WHEN total < 500 THEN total > 0 ELSE total > 500 + 250 * floor((total - 500) / 250.0) END) AND rn > total - 500),
hop AS (SELECT * FROM h UNION ALL SELECT * FROM t)"""


def rnd(x: str, places: int = 4) -> str:
    return f"round(CAST({x} AS DOUBLE), {places}) + 0.0"


def window_stats(columns: list[str]) -> str:
    """mean, population deviation, least and largest of each column, and the profile's entropy."""
    out = ["count(*) AS n"]
    for c in columns:
        out += [f"{rnd(f'avg({c})')} AS mean_{c}", f"{rnd(f'stddev_pop({c})')} AS std_{c}", f"{rnd(f'min({c})')} AS min_{c}", f"{rnd(f'max({c})')} AS max_{c}"]
    level = [f"(coalesce(avg(abs({c})), 0) + 1e-12)" for c in columns]
    total = "(" + " + ".join(level) + ")"
    out.append(rnd("-(" + " + ".join(f"({v} / {total}) * ln({v} / {total})" for v in level) + ")") + " AS entropy")
    return ", ".join(out)


def band(x: str, p: str) -> str:
    return f"(CASE WHEN {x} > {p}99 THEN 1.0 WHEN {x} > {p}95 THEN 0.5 WHEN {x} < {p}01 THEN 1.0 WHEN {x} < {p}05 THEN 0.5 ELSE 0.0 END)"


def cls(o: str, r: str) -> str:
    return f"CASE WHEN {o} > 0 AND {r} > 0 THEN 'both' WHEN {o} > 0 AND {r} = 0 THEN 'orig' WHEN {r} > 0 AND {o} = 0 THEN 'resp' WHEN {o} = 0 AND {r} = 0 THEN 'none' END"


def volume(u: str) -> str:
    o, r = f"orig_{u}", f"resp_{u}"
    return f"CASE WHEN {o} > 0 AND {r} > 0 THEN {o} / ({r} + 1e-9) WHEN {o} > 0 AND {r} = 0 THEN {o} WHEN {r} > 0 AND {o} = 0 THEN {r} END"


def rate(u: str) -> str:
    return f"CASE WHEN duration > 0 AND orig_{u} + resp_{u} > 0 THEN (orig_{u} + resp_{u}) / duration END"


def class_profile(value: str, u: str, source: str = "f", key: str = "pod") -> str:
    """A SELECT of the class profile per key, unrounded."""
    stats = ", ".join(f"quantile_cont(v, {p}) AS p{round(100 * p):02d}" for p in (0.01, 0.05, 0.5, 0.95, 0.99))
    q = ", ".join(f"coalesce(s.p{p}, -1.0) AS p{p}" for p in ("01", "05", "50", "95", "99"))
    return f"""SELECT k.{key}, c.cls, coalesce(s.n, 0) AS n, coalesce(s.mean, -1.0) AS mean, coalesce(s.std, -1.0) AS std, {q}
FROM (SELECT DISTINCT {key} FROM {source}) k CROSS JOIN (VALUES ('both'), ('orig'), ('resp')) c(cls)
LEFT JOIN (SELECT {key}, cls, count(v) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std, {stats}
           FROM (SELECT {key}, {cls(f'orig_{u}', f'resp_{u}')} AS cls, CAST({value} AS DOUBLE) AS v FROM {source}) WHERE v IS NOT NULL AND cls <> 'none' GROUP BY {key}, cls) s
ON s.{key} = k.{key} AND s.cls = c.cls"""


def rounded_profile(value: str, u: str) -> str:
    cols = ", ".join(f"{rnd(c)} AS {c}" for c in ("mean", "std", "p01", "p05", "p50", "p95", "p99"))
    return f"WITH {FLOW} SELECT pod, cls, n, {cols} FROM ({class_profile(value, u)})"


#: One row of thresholds per pod, and every flow scored by the ruleset of pod ``rules``.
def ruleset(source: str = "f") -> str:
    wide = lambda name, value, u: f"{name} AS (SELECT pod, " + ", ".join(f"max(CASE WHEN cls = '{c}' THEN p{p} END) AS {name}_{c}_p{p}" for c in ("both", "orig", "resp") for p in ("01", "05", "95", "99")) + f" FROM ({class_profile(value, u, source)}) GROUP BY pod)"
    dur = "dur AS (SELECT pod, " + ", ".join(f"quantile_cont(duration, {p}) AS dur_p{round(100 * p):02d}" for p in (0.01, 0.05, 0.95, 0.99)) + f" FROM {source} GROUP BY pod)"
    parts = [wide("vol", volume("bytes"), "bytes"), wide("pkt", volume("pkts"), "pkts"), wide("bps", rate("bytes"), "bytes"), wide("pps", rate("pkts"), "pkts"), dur]
    return ", ".join(parts) + ", rules AS (SELECT * FROM dur JOIN vol USING (pod) JOIN pkt USING (pod) JOIN bps USING (pod) JOIN pps USING (pod))"


def _class_band(name: str, value: str, c: str) -> str:
    return f"(CASE {c} " + " ".join(f"WHEN '{k}' THEN {band(value, f'{name}_{k}_p')}" for k in ("both", "orig", "resp")) + " ELSE 0.0 END)"


def row_parts() -> str:
    """The five parts of a row's score, over columns ob, rb, op, rp, d, bc, pc and the thresholds."""
    amount = lambda c, o, r: f"CASE {c} WHEN 'both' THEN {o} / ({r} + 1e-9) WHEN 'orig' THEN {o} ELSE {r} END"
    return ", ".join([
        f"{band('d', 'dur_p')} AS dur_part",
        f"{_class_band('vol', '(' + amount('bc', 'ob', 'rb') + ')', 'bc')} AS vol_part",
        f"{_class_band('pkt', '(' + amount('pc', 'op', 'rp') + ')', 'pc')} AS pkt_part",
        f"CASE WHEN d > 0 THEN {_class_band('bps', '((ob + rb) / d)', 'bc')} ELSE 0.0 END AS bps_part",
        f"CASE WHEN d > 0 THEN {_class_band('pps', '((op + rp) / d)', 'pc')} ELSE 0.0 END AS pps_part",
    ])


def scored(join: str, extra: str) -> str:
    """CTEs up to ``scored``: flows with the score by the rules they are joined to."""
    zero = f"z AS (SELECT *, coalesce(orig_bytes, 0) AS ob, coalesce(resp_bytes, 0) AS rb, coalesce(orig_pkts, 0) AS op, coalesce(resp_pkts, 0) AS rp, coalesce(duration, 0) AS d FROM f), zc AS (SELECT *, {cls('ob', 'rb')} AS bc, {cls('op', 'rp')} AS pc FROM z)"
    return f"{FLOW}, {ruleset()}, {zero}, parts AS (SELECT {extra}, {row_parts()} FROM zc {join}), scored AS (SELECT *, 0.1 * dur_part + 0.1 * vol_part + 0.1 * pkt_part + 0.35 * bps_part + 0.35 * pps_part AS score FROM parts)"


def dft(series: str, keys: str, tag: str = "") -> str:
    """CTEs ``y`` (keys, i, y, n) from ``series`` and ``spec`` (keys, fk, n, m) by the definition; ``tag`` ends their names."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    by = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""y{tag} AS ({series}),
ks{tag} AS (SELECT {keys}, max(n) AS n, unnest(range(0, CAST(max(n) // 2 AS BIGINT) + 1)) AS fk FROM y{tag} GROUP BY {keys}),
spec{tag} AS (SELECT {by}, a.fk, a.n, round(sqrt(sum(b.y * cos(2 * pi() * a.fk * b.i / a.n)) ^ 2 + sum(b.y * sin(2 * pi() * a.fk * b.i / a.n)) ^ 2), 9) AS m FROM ks{tag} a JOIN y{tag} b ON {on} GROUP BY {by}, a.fk, a.n)"""


def spectral(keys: str, tag: str = "") -> str:
    """SELECT of n and the four metrics per key from ``y`` and ``spec``."""
    on = " AND ".join(f"s.{k} = t.{k}" for k in keys.split(", "))
    by = ", ".join(f"s.{k}" for k in keys.split(", "))
    both = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    cols = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""SELECT {cols}, CAST(a.n AS BIGINT) AS n, coalesce(energy, 0.0) AS energy, coalesce(entropy, 0.0) AS entropy, coalesce(dominant_freq, 0.0) AS dominant_freq, coalesce(hf_lf, 0.0) AS hf_lf
FROM (SELECT {keys}, max(n) AS n FROM y{tag} GROUP BY {keys}) a LEFT JOIN (
SELECT {by}, sum(s.m * s.m) AS energy, -sum((s.m / (t.total + 1e-12)) * ln(s.m / (t.total + 1e-12) + 1e-12)) AS entropy,
  CAST(min(s.fk) FILTER (WHERE s.m = t.top) AS DOUBLE) / max(s.n) AS dominant_freq,
  (coalesce(sum(s.m) FILTER (WHERE s.fk > (s.n // 2) // 2), 0) + 1e-9) / (coalesce(sum(s.m) FILTER (WHERE s.fk <= (s.n // 2) // 2), 0) + 1e-9) AS hf_lf
FROM spec{tag} s JOIN (SELECT {keys}, sum(m) AS total, max(m) AS top FROM spec{tag} WHERE fk > 0 GROUP BY {keys}) t ON {on} WHERE s.fk > 0 AND s.n >= 4 GROUP BY {by}) b ON {both}"""
