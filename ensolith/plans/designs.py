"""Queries of designs over bounds that the tables give, and of sensitivity from any cloud of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ensolith.operators import designs as D
from ensolith.operators import given_data as G
from ensolith.operators import sensitivity as V
from ensolith.operators import sobol as S
from ensolith.plans.registry import query, table

_NAMES = ["discount", "price", "quantity"]
_COLUMNS = ["l_discount", "l_extendedprice", "l_quantity"]
_BOUNDS = "b AS (SELECT " + ", ".join(f"min({c}) AS lo{k}, max({c}) AS hi{k}" for k, c in enumerate(_COLUMNS)) + " FROM lineitem)"


def _bounds(spark, d):
    """The span of three columns of lineitem, a row each."""
    ends = table(spark, d, "lineitem").agg(F.array(*(F.struct(F.lit(n).alias("name"), F.min(c).alias("lower"), F.max(c).alias("upper")) for n, c in zip(_NAMES, _COLUMNS))).alias("b"))
    return ends.select(F.inline("b"))


def _unit(number: str, dims: int, seed: int, bits: int) -> list[str]:
    """SQL of the coordinates of Sobol points."""
    out = []
    for v, shift in zip(S.direction_numbers(dims), S.shifts(dims, seed)):
        x = f"{shift}::BIGINT"
        for j in range(bits):
            x = f"xor({x}, ((xor({number}, {number} >> 1) >> {j}) & 1) * {v[j]}::BIGINT)"
        out.append(f"({x} / {1 << S.BITS}::DOUBLE)")
    return out


def _power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


@query()
def d1_morris_design(spark, d):
    """A trajectory for each supplier in the box of lineitem's columns (rows only: the tests check that each step moves one parameter by delta)."""
    n = table(spark, d, "supplier").count()
    return D.in_box(D.morris_trajectories(spark, n, _NAMES, 4, 11), S.box(_bounds(spark, d)))


@query()
def d3_latin_hypercube(spark, d):
    """D3: a Latin hypercube of a point for each supplier in the box of lineitem's columns (rows only: the tests check every slice is hit once)."""
    return D.in_box(V.latin_hypercube(spark, table(spark, d, "supplier").count(), _NAMES, 7), S.box(_bounds(spark, d)))


_POINT = ", ".join(f"round(lo{k} + {u} * (hi{k} - lo{k}), 7) AS {n}" for k, (n, u) in enumerate(zip(_NAMES, _unit("o_orderkey", 3, 7, 30))))


@query(f"WITH {_BOUNDS} SELECT o_orderkey, {_POINT} FROM orders, b")
def d4_sobol_points(spark, d):
    """The shifted Sobol point of every order in the box of lineitem's columns."""
    p = S.sequence_points(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", _bounds(spark, d), 7)
    return p.select("o_orderkey", *(F.round(n, 7).alias(n) for n in _NAMES))


_U6 = _unit("i", 6, 5, 20)
_AT = lambda k, b: f"(lo{k} + u{k + 3 * b} * (hi{k} - lo{k}))"
_F = lambda *of: f"({_AT(2, of[2])} / 50 + {_AT(0, of[0])} * 20 * {_AT(1, of[1])} / 50000)"
_ROWS = {"a": (0, 0, 0), "b": (1, 1, 1), "x0": (1, 0, 0), "x1": (0, 1, 0), "x2": (0, 0, 1), "y0": (0, 1, 1), "y1": (1, 0, 1), "y2": (1, 1, 0)}
_EVALUATED = f"WITH {_BOUNDS}, u AS MATERIALIZED (SELECT {', '.join(f'{u} AS u{k}' for k, u in enumerate(_U6))} FROM (SELECT unnest(range(CAST(2 ** ceil(log2(count(*))) AS BIGINT))) AS i FROM part)), f AS (SELECT {', '.join(f'{_F(*of)} AS {n}' for n, of in _ROWS.items())} FROM u, b), m AS (SELECT (avg(a) + avg(b)) / 2 AS m, (var_pop(a) + var_pop(b)) / 2 + ((avg(a) - avg(b)) / 2) ** 2 AS v FROM f), c AS (SELECT {', '.join(f'{n} - m AS {n}' for n in _ROWS)}, v FROM f, m)"


def _evaluated(spark, d):
    n = _power_of_two(table(spark, d, "part").count())
    y = F.col("quantity") / 50 + F.col("discount") * 20 * F.col("price") / 50000
    return S.crossed_design(spark, _bounds(spark, d), n, True, 5).withColumn("y", y)


@query(f"{_EVALUATED} SELECT input, round(first, 6) AS first, round(total, 6) AS total FROM ({' UNION ALL '.join(f'''SELECT '{n}' AS input, avg(b * (x{k} - a)) / any_value(v) AS first, avg((a - x{k}) ** 2) / 2 / any_value(v) AS total FROM c''' for k, n in enumerate(_NAMES))})")
def d8_crossed_indices(spark, d):
    """A crossed Sobol design of as many points as there are parts, a function of it, and its first and total order shares."""
    return S.first_and_total(_evaluated(spark, d), _NAMES, "y").select("input", F.round("first", 6).alias("first"), F.round("total", 6).alias("total"))


@query(f"{_EVALUATED} SELECT input, other, round(second, 6) AS second FROM ({' UNION ALL '.join(f'''SELECT '{_NAMES[j]}' AS input, '{_NAMES[k]}' AS other, (avg(y{j} * x{k} - a * b) - avg(b * (x{j} - a)) - avg(b * (x{k} - a))) / any_value(v) AS second FROM c''' for j in range(3) for k in range(j + 1, 3))})")
def d8_second_order(spark, d):
    """Shares of the interactions of each two parameters."""
    return S.second_order(_evaluated(spark, d), _NAMES, "y").select("input", "other", F.round("second", 6).alias("second"))


@query("WITH s AS (SELECT s_nationkey AS nation, s_name AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier), t AS (SELECT nation, list(name ORDER BY k) AS m FROM s WHERE k <= 4 GROUP BY 1), e AS (SELECT nation, m, unnest(range(1, (1 << len(m)))) AS experiment FROM t) SELECT nation, CAST(experiment AS INTEGER) AS experiment, array_to_string([x[1] FOR x IN list_zip(m, range(len(m))) IF (experiment >> x[2]) & 1 = 1], ',') AS members FROM e")
def d12_factorial_experiments(spark, d):
    """All non-empty subsets of the proposed changes, here of each nation's first four suppliers."""
    listed = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda s: s["s_name"]), 1, 4).alias("members"))
    return D.subsets(listed, "members").select("nation", "experiment", F.array_join("members", ",").alias("members"))


_INPUTS = ["mean_quantity", "retail", "size"]
_CLOUD = "p AS (SELECT p_partkey AS key, avg(l_extendedprice * (1 - l_discount)) AS y, avg(l_quantity) AS mean_quantity, any_value(p_retailprice) AS retail, CAST(any_value(p_size) AS DOUBLE) AS size FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1), r AS MATERIALIZED (SELECT key, y, input, row_number() OVER (PARTITION BY input ORDER BY x, key) - 1 AS place, count(*) OVER (PARTITION BY input) AS n FROM (UNPIVOT p ON mean_quantity, retail, size INTO NAME input VALUE x))"


def _cloud(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"), F.avg("l_quantity").alias("mean_quantity"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("retail"), F.col("p_size").alias("size"))
    return G.ranked_inputs(li.join(p, "key"), _INPUTS, "y", "key")


@query(f"WITH {_CLOUD}, t AS (SELECT input, y, n, 2 * pi() * (CASE WHEN place % 2 = 0 THEN place // 2 ELSE n - 1 - (place - 1) // 2 END) / n AS t FROM r), s AS (SELECT input, h, any_value(n) AS n, sum(y * cos(h * t)) AS c, sum(y * sin(h * t)) AS s, var_pop(y) * count(*) AS v FROM t, (SELECT unnest(range(1, 11)) AS h) GROUP BY ALL), q AS (SELECT input, sum(2 * (c * c + s * s) / n) / any_value(v) AS share, any_value(20.0 / n) AS noise FROM s GROUP BY 1) SELECT input, round(share - noise / (1 - noise) * (1 - share), 6) AS first FROM q")
def m1_spectral_share(spark, d):
    """M1: the share of variance in the first harmonics along each input (RBD-FAST)."""
    return G.spectral_share(_cloud(spark, d)).select("input", F.round("first", 6).alias("first"))


def _delta(rows: str, keys: str) -> str:
    """SQL of the density distance of rows (keys, input, place, n, y) over ten slices."""
    return f"""e AS (SELECT min(y) AS lo, max(y) AS hi, (max(y) - min(y)) / 1024 AS step FROM {rows}),
c0 AS (SELECT {keys}, input, (place * 10) // n AS slice, least(1023, CAST(floor((y - lo) / step) AS INT)) AS bin, count(*) AS c, sum(y) AS s, sum(y * y) AS q FROM {rows}, e GROUP BY ALL),
c AS MATERIALIZED (SELECT * FROM c0 UNION ALL SELECT {keys}, input, -1, bin, sum(c), sum(s), sum(q) FROM c0 GROUP BY ALL),
w AS (SELECT {keys}, input, slice, sum(c) AS n, greatest(any_value(step), sqrt(greatest(0, (sum(q) - sum(s) ** 2 / sum(c)) / (sum(c) - 1))) * (sum(c) * 0.75) ** -0.2) AS h FROM c, e GROUP BY ALL),
g AS (SELECT i, lo + (hi - lo) * i / 99 AS z FROM e, (SELECT unnest(range(100)) AS i)),
f AS MATERIALIZED (SELECT {keys}, c.input, c.slice, i, any_value(w.n) AS n, sum(c * exp(-0.5 * ((z - lo - (bin + 0.5) * step) / h) ** 2)) / any_value(w.n * h * sqrt(2 * pi())) AS f FROM c JOIN w USING ({keys}, input, slice), g, e GROUP BY ALL),
gap AS (SELECT {keys}, a.input, a.slice, a.i, a.n, b.n AS every, abs(a.f - b.f) AS gap FROM f a JOIN f b USING ({keys}, input, i) WHERE a.slice >= 0 AND b.slice = -1),
area AS (SELECT {keys}, input, slice, any_value(n / (2 * every)) * (sum(gap) - sum(gap) FILTER (i IN (0, 99)) / 2) AS a FROM gap GROUP BY ALL),
delta AS (SELECT {keys}, input, sum(a) * (SELECT (hi - lo) / 99 FROM e) AS delta FROM area GROUP BY ALL)"""


@query(f"WITH {_CLOUD}, r1 AS (SELECT 1 AS one, * FROM r), {_delta('r1', 'one')} SELECT input, round(delta, 6) AS delta FROM delta")
def m1_density_distance(spark, d):
    """M1: half the area between the densities in slices of each input and over all (delta)."""
    return G.density_distance(_cloud(spark, d), slices=10).select("input", F.round("delta", 6).alias("delta"))


def _scattered(key: str, salt: int) -> str:
    x = f"((({key}) * 48271 + {salt}) % 2147483647)"
    z = f"(({x} * {x} % 2147483647 + {x} * 40692) % 2147483647)"
    return f"({z} * {z} % 2147483647)"


@query(f"WITH {_CLOUD}, o AS MATERIALIZED (SELECT key, y, n, row_number() OVER (ORDER BY {_scattered('key', 17)}, key) AS k FROM r WHERE input = 'size'), m AS (SELECT turn, y, (k + 1 + {_scattered('turn', 3)} % (n - 1)) % n AS goal FROM o, (SELECT unnest(range(1, 4)) AS turn)), z AS (SELECT turn, input, place, r.n, m.y FROM r JOIN o ON r.key = o.key JOIN m ON m.goal = o.k % o.n), {_delta('z', 'turn')} SELECT round(max(delta), 6) AS floor FROM delta")
def m2_delta_floor(spark, d):
    """M2: the largest density distance of any input when outputs are dealt to other rows."""
    return G.noise_floor(_cloud(spark, d), 3, 10).select(F.round("floor", 6).alias("floor"))
