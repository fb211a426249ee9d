"""The sketches as DuckDB SQL, written from the same spec: the oracle of the queries.

It shares no code with the DataFrame operators but the spec's numbers; hashes, order statistics, quantizers and
estimators are spelled out once more.
"""

from __future__ import annotations

import math

from ..functions.hashing import GOLDEN, MIX1, MIX2
from ..operators.estimate import hll_alpha
from ..operators.registers import LN2, TINY
from ..spec import SketchSpec

_M = "18446744073709551616::UHUGEINT"


def source_sql(source: str, keys: list[str], weighted: bool) -> str:
    """Distinct elements with their greatest weight, and their hash; ``source`` gives keys, x and w."""
    cols = ", ".join(keys)
    w = "max(w)::DOUBLE" if weighted else "1.0::DOUBLE"
    return f"SELECT {cols}, x, {w} AS w FROM ({source}) WHERE x IS NOT NULL AND w IS NOT NULL GROUP BY {cols}, x"


def hash_sql(seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || x), 1, 15))::UBIGINT"


def mixer_sql(name: str, source: str, index: str) -> list[str]:
    """CTEs that add ``z``, the mixed bits of ``h`` and an index."""
    return [
        f"{name}0 AS (SELECT *, ((h::UHUGEINT + (({index}) + 1)::UHUGEINT * {GOLDEN}::UHUGEINT) % {_M})::UBIGINT AS z FROM {source})",
        f"{name}1 AS (SELECT * REPLACE ((xor(z, z >> 30)::UHUGEINT * {MIX1}::UHUGEINT % {_M})::UBIGINT AS z) FROM {name}0)",
        f"{name}2 AS (SELECT * REPLACE ((xor(z, z >> 27)::UHUGEINT * {MIX2}::UHUGEINT % {_M})::UBIGINT AS z) FROM {name}1)",
        f"{name} AS (SELECT * REPLACE (xor(z, z >> 31) AS z) FROM {name}2)",
    ]


UNIT = "((z >> 12) + 1)::DOUBLE / 4503599627370496.0::DOUBLE"


def quantize_sql(v: str, exp_bits: int, mant_bits: int, mode: str = "ALL_NORMAL") -> str:
    bias = (1 << (exp_bits - 1)) - 1
    high = math.ldexp(2.0 - 2.0**-mant_bits, (1 << exp_bits) - 1 - bias)
    low = 2.0 ** (1 - bias - mant_bits if mode == "WITH_SUBNORMALS" else -bias)
    levels, scale = float(1 << (exp_bits + mant_bits)) - 1, float(1 << mant_bits)
    low_, high_ = f"{low!r}::DOUBLE", f"{high!r}::DOUBLE"
    if mode == "LINEAR":
        step = f"{(high - low) / levels!r}::DOUBLE"
        inner, under = f"{low_} + floor(({v} - {low_}) / {step}) * {step}", f"{v} <= {low_}"
    elif mode == "LOGARITHMIC":
        step = f"{math.log(high / low) / levels!r}::DOUBLE"
        inner, under = f"{low_} * exp(floor(ln({v} / {low_}) / {step}) * {step})", f"{v} <= {low_}"
    else:
        guess = f"floor(log2({v}))"
        e = f"(CASE WHEN pow(2.0::DOUBLE, {guess}) > {v} THEN {guess} - 1 WHEN pow(2.0::DOUBLE, {guess} + 1) <= {v} THEN {guess} + 1 ELSE {guess} END)"
        inner = f"(1 + floor(({v} / pow(2.0::DOUBLE, {e}) - 1) * {scale!r}::DOUBLE) / {scale!r}::DOUBLE) * pow(2.0::DOUBLE, {e})"
        if mode == "WITH_SUBNORMALS":
            inner = f"CASE WHEN {e} + {bias} >= 1 THEN {inner} ELSE floor({v} / {low_}) * {low_} END"
        under = f"{v} < {low_}"
    return f"CASE WHEN {under} THEN {low_} WHEN {v} >= {high_} THEN {high_} ELSE {inner} END"


def value_sql(spec: SketchSpec, g: str) -> str:
    kind, log = spec.kind, f"ln(greatest({g}, {TINY!r}::DOUBLE))"
    if spec.traits.value == "float":
        return f"({g})::FLOAT"
    if kind.startswith("LogExp"):
        index = f"floor(ln(greatest({g}, {TINY!r}::DOUBLE) / {spec.scale!r}::DOUBLE) / {spec.log_step!r}::DOUBLE + 0.5)"
        return f"least(greatest({index}, 0), {spec.capacity})::INTEGER" if kind.endswith("NoShifted") else f"({index})::INTEGER"
    if spec.traits.value == "int":
        step = repr(LN2) if kind.startswith("QSketch") else repr(spec.log_step)
        index = f"floor(-{log} / {step}::DOUBLE{' + 0.5' if kind.startswith('kQSketchRound') else ''})"
        return f"({index})::INTEGER" if kind == "kQSketchShifted" else f"least(greatest({index}, {spec.r_min}), {spec.r_max})::INTEGER"
    if spec.exp_bits is not None:
        return quantize_sql(g, spec.exp_bits, spec.mant_bits)
    return g


def registers_ctes(spec: SketchSpec, source: str, keys: list[str]) -> list[str]:
    """CTEs that end with ``registers`` (keys, i, r)."""
    cols, m, family = ", ".join(keys), spec.m, spec.traits.family
    out = [f"el AS ({source_sql(source, keys, spec.is_weighted)})", f"hashed AS (SELECT *, {hash_sql(spec.seed)} AS h FROM el)"]
    if family == "independent":
        out += mixer_sql("mx", f"(SELECT *, t.i AS i FROM hashed, range({m}) AS t(i))", "i")
        value = f"pow({UNIT}, 1.0 / w)" if spec.kind == "WeightedMinHash" else value_sql(spec, f"(-ln({UNIT}) / w)")
        out += [f"vals AS (SELECT {cols}, i, {value} AS r FROM mx)"]
    elif family == "ordered":
        out += mixer_sql("mx", f"(SELECT *, t.i AS k FROM hashed, range({m}) AS t(i))", "k")
        out += [f"ex AS (SELECT * EXCLUDE z, -ln({UNIT}) / w / ({m} - k) AS e FROM mx)"]
        out += mixer_sql("px", "ex", f"k + {m}")
        out += [
            f"st AS (SELECT {cols}, sum(e) OVER (PARTITION BY {cols}, x ORDER BY k ROWS UNBOUNDED PRECEDING) AS g, row_number() OVER (PARTITION BY {cols}, x ORDER BY z >> 12, k) - 1 AS i FROM px)",
            f"vals AS (SELECT {cols}, i, {value_sql(spec, 'g')} AS r FROM st)",
        ]
    else:
        out += mixer_sql("bx", "hashed", str(2 * m))
        out += [f"bu AS (SELECT * EXCLUDE z, ((z >> 12) % {m})::INTEGER AS i FROM bx)"]
        out += mixer_sql("gx", "bu", str(2 * m + 1))
        out += [f"gv AS (SELECT * EXCLUDE z, -ln({UNIT}) / w AS g FROM gx)"]
        out += mixer_sql("rx", "gv", str(2 * m + 2))
        value = "(CASE WHEN z >> 12 = 0 THEN 53 ELSE 53 - length(bin(z >> 12)) END)::INTEGER" if spec.kind == "HyperLogLog" else value_sql(spec, "g")
        out += [f"vals AS (SELECT {cols}, i, {value} AS r FROM rx)"]
    join = "min" if spec.traits.least else "max"
    out += [f"registers AS (SELECT {cols}, i::INTEGER AS i, {join}(r) AS r FROM vals GROUP BY {cols}, i)"]
    if spec.kind == "kQSketchShifted":
        out[-1] = out[-1].replace("registers AS", "lattice AS")
        out += [f"registers AS (SELECT {cols}, i, greatest(r, max(r) OVER (PARTITION BY {cols}) - {spec.capacity}, -1022)::INTEGER AS r FROM lattice)"]
    return out


def rounded(spec: SketchSpec) -> str:
    return "r" if spec.traits.value == "int" else "round(r::DOUBLE, 12)"


def registers_sql(spec: SketchSpec, source: str, keys: list[str]) -> str:
    return f"WITH {', '.join(registers_ctes(spec, source, keys))} SELECT {', '.join(keys)}, i, {rounded(spec)} AS r FROM registers"


def weight_sql(spec: SketchSpec) -> str:
    """What a register adds to the estimator's sum."""
    if spec.kind.startswith("LogExp"):
        return f"{spec.scale!r}::DOUBLE * exp(r * {spec.log_step!r}::DOUBLE)"
    if spec.kind == "WeightedMinHash":
        return "1 - r"
    if spec.kind in ("QSketch", "HyperLogLog"):
        return "pow(2.0::DOUBLE, -r)"
    if spec.traits.value == "int":
        return f"exp(-r * {spec.log_step!r}::DOUBLE)"
    return "r::DOUBLE"


def newton_ctes(spec: SketchSpec, keys: list[str], start: str = "default", turns: int = 30) -> list[str]:
    """A fixed number of Newton steps from ``registers``; ``n29`` has the root."""
    cols, m = ", ".join(keys), spec.m
    base = LN2 if spec.kind == "QSketch" else spec.log_step
    if start == "warm":
        first = f"{(spec.logarithm_base - 1) * m / spec.log_step!r}::DOUBLE / sum(c * exp(-r * {base!r}::DOUBLE))"
    elif start == "cold":
        first = f"exp({base!r}::DOUBLE * min(r))"
    else:
        first = f"{m - 1} / sum(c * exp(-r * {base!r}::DOUBLE))"
    out = [f"hist AS (SELECT {cols}, r, count(*) AS c FROM registers GROUP BY {cols}, r)", f"n0 AS (SELECT {cols}, {first} AS w FROM hist GROUP BY {cols})"]
    if spec.kind == "QSketch":
        e = "(exp(least(w * x, 700)) - 1)"
        point = "pow(2.0::DOUBLE, -r - 1) AS x, 0.0::DOUBLE AS low"
        f, d = f"x * (1 - {e}) / {e}", f"x * x * ({e} + 1) / ({e} * {e})"
    else:
        e = "(exp(least(w * x, 700)) - 1)"
        point = f"exp(-r * {base!r}::DOUBLE) * (1 - exp(-{base!r}::DOUBLE)) AS x, exp(-(r + 1) * {base!r}::DOUBLE) AS low"
        f, d = f"x / {e} - low", f"x * x * ({e} + 1) / ({e} * {e})"
    out += [f"pts AS (SELECT {cols}, c, {point} FROM hist)"]
    for k in range(1, turns):
        step = f"sum(c * ({f})) / -sum(c * ({d}))"
        out += [f"n{k} AS (SELECT {cols}, CASE WHEN w - step <= 0 THEN w / 2 ELSE w - step END AS w FROM (SELECT {cols}, any_value(w) AS w, {step} AS step FROM pts JOIN n{k - 1} USING ({cols}) GROUP BY {cols}))"]
    return out


def estimate_ctes(spec: SketchSpec, keys: list[str]) -> list[str]:
    """CTEs that end with ``estimates`` (keys, estimate), from ``registers``."""
    cols, m = ", ".join(keys), spec.m
    if spec.kind in ("QSketch", "kQSketch", "kQSketchShifted"):
        return [*newton_ctes(spec, keys), f"estimates AS (SELECT {cols}, w AS estimate FROM n29)"]
    if spec.kind.startswith("WeightedHyperLogLog"):
        out = f"(CASE WHEN n = 1 THEN 0.5 ELSE (n - 1)::DOUBLE / n END) * n * {m} / s"
    elif spec.kind == "HyperLogLog":
        raw = f"{hll_alpha(m) * m * m!r}::DOUBLE / (s + {m} - n)"
        out = f"CASE WHEN {raw} <= {2.5 * m} AND n < {m} THEN {m} * ln({float(m)!r}::DOUBLE / ({m} - n)) ELSE {raw} END"
    else:
        out = f"{m - 1} / s"
    return [f"sums AS (SELECT {cols}, sum({weight_sql(spec)}) AS s, count(*) AS n FROM registers GROUP BY {cols})", f"estimates AS (SELECT {cols}, {out} AS estimate FROM sums)"]


def estimate_sql(spec: SketchSpec, source: str, keys: list[str]) -> str:
    return f"WITH {', '.join(registers_ctes(spec, source, keys) + estimate_ctes(spec, keys))} SELECT {', '.join(keys)}, round(estimate, 3) AS estimate FROM estimates"


def prefixed(ctes: list[str], prefix: str, inputs: tuple[str, ...] = ()) -> list[str]:
    """The same CTEs under other names, so that two chains fit in one statement."""
    import re

    own = [c.split(" AS ", 1)[0] for c in ctes]
    return [re.sub(r"\b(" + "|".join(own) + r")\b(?!\s*\()", lambda k: prefix + k[0], c.split(" AS ", 1)[0]) + " AS " + re.sub(r"(?<=FROM |JOIN )(" + "|".join(own) + r")\b", lambda k: prefix + k[0], c.split(" AS ", 1)[1]) for c in ctes]


def records_ctes(spec: SketchSpec, source: str, keys: list[str]) -> list[str]:
    """CTEs that end with ``recs`` (keys, o, x, w, i, r, before); ``source`` gives keys, x, w, o."""
    cols, m = ", ".join(keys), spec.m
    w = "w::DOUBLE" if spec.is_weighted else "1.0::DOUBLE"
    out = [f"el AS (SELECT {cols}, x, w, min(o) AS o FROM (SELECT {cols}, x, {w} AS w, o FROM ({source})) GROUP BY {cols}, x, w)", f"hashed AS (SELECT *, {hash_sql(spec.seed)} AS h FROM el)"]
    if spec.kind == "MartingaleMinHash":
        out += mixer_sql("mx", f"(SELECT *, t.i AS i FROM hashed, range({m}) AS t(i))", "i")
        out += [f"vals AS (SELECT *, -ln({UNIT}) AS r FROM mx)"]
    else:
        out += mixer_sql("bx", f"(SELECT * REPLACE ({hash_sql(spec.g_seed)} AS h) FROM hashed)", str(2 * m))
        out += [f"bu AS (SELECT * EXCLUDE z REPLACE ({hash_sql(spec.seed)} AS h), ((z >> 12) % {m})::INTEGER AS i FROM bx)"]
        out += mixer_sql("gx", "bu", str(2 * m + 1))
        out += [f"vals AS (SELECT *, {value_sql(spec, f'(-ln({UNIT}) / w)')} AS r FROM gx)"]
    join, test = ("min", "before IS NULL OR r < before") if spec.traits.least else ("max", "r > before")
    before = f"{join}(r) OVER (PARTITION BY {cols}, i ORDER BY o, x, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    if not spec.traits.least:
        before = f"coalesce({before}, {spec.r_min})"
    return [*out, f"recs AS (SELECT * FROM (SELECT {cols}, o, x, w, i, r, {before} AS before FROM vals) WHERE {test})"]


def martingale_sql(spec: SketchSpec, source: str, keys: list[str]) -> str:
    cols = ", ".join(keys)
    ctes = records_ctes(spec, source, keys) + [
        f"rws AS (SELECT {cols}, o, x, sum(r - coalesce(before, 0)) AS d FROM recs GROUP BY {cols}, o, x)",
        f"past AS (SELECT {cols}, sum(d) OVER (PARTITION BY {cols} ORDER BY o, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM rws)",
    ]
    return f"WITH {', '.join(ctes)} SELECT {cols}, round(sum(CASE WHEN s IS NULL THEN 1 ELSE 1 / (1 - exp(-s)) END), 4) AS estimate FROM past GROUP BY {cols}"


def dyn_sql(spec: SketchSpec, source: str, keys: list[str], post_update: bool = False) -> str:
    """Each change meets the registers as they stood: intervals of changes, and the untouched ones."""
    cols, m = ", ".join(keys), spec.m
    base, shift = (LN2, 1.0) if spec.kind == "QSketchDyn" else (spec.log_step, 0.5)
    rate = f"exp(-e.w * exp(-(v.r + {shift}) * {base!r}::DOUBLE))"
    held = "v.n < e.n AND (v.until IS NULL OR v.until >= e.n)" if not post_update else "v.n <= e.n AND (v.until IS NULL OR v.until > e.n)"
    on = " AND ".join(f"v.{k} = e.{k}" for k in keys)
    ekeys = ", ".join(f"e.{k}" for k in keys)
    ctes = records_ctes(spec, source, keys) + [
        f"num AS (SELECT *, row_number() OVER (PARTITION BY {cols} ORDER BY o, x, w) AS n FROM recs)",
        f"iv AS (SELECT *, lead(n) OVER (PARTITION BY {cols}, i ORDER BY n) AS until FROM (SELECT {cols}, i, r, n FROM num UNION ALL SELECT {cols}, t.i::INTEGER, {spec.r_min}, 0 FROM (SELECT DISTINCT {cols} FROM num), range({m}) AS t(i)))",
        f"ch AS (SELECT {ekeys}, e.n, any_value(e.w) AS w, 1 - sum({rate}) / {m} AS q FROM num e JOIN iv v ON {on} AND {held} GROUP BY {ekeys}, e.n)",
    ]
    return f"WITH {', '.join(ctes)} SELECT {cols}, round(sum(w / q), 3) AS estimate FROM ch GROUP BY {cols}"
