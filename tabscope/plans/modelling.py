"""Feature preparation, models, clusterings and their scores.

The credit features are the model input wherever a model takes several columns; the two numeric
part columns serve the neighbour and density work, whose SQL compares all pairs of rows.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscope.operators import clean, density, features, medoids, models, neighbors, report, silhouette
from tabscope.plans import Catalog
from tabscope.plans.views import CREDIT_SQL, FEATURES, on_credit, order_profile, parts, rounded, scaled_sql, table, with_ctes, written_profile
from tabscope.scratch import materialize, new_path

catalog = Catalog()
query = catalog.query

PART = ["p_size", "p_retailprice"]
PART_EPS = 0.1
FOUR = ["edad", "radio_deuda", "uso_de_credito", "num_dependientes"]
REST = [f for f in FEATURES if f != "ingreso_mensual"]
EMBEDDING_SIZE = 64
EMBEDDED = [f"x{i}" for i in range(EMBEDDING_SIZE)]


def scaled_credit(spark: SparkSession, folder: str) -> DataFrame:
    rows = written_profile(spark, folder).select("ID", "nivel_riesgo", "delincuencia_reciente", *FEATURES).na.drop()
    return features.standardize(rows, FEATURES)


def scaled_parts(spark: SparkSession, folder: str) -> DataFrame:
    return features.standardize(parts(spark, folder), PART, digits=6)


def embedded(spark: SparkSession, folder: str) -> DataFrame:
    return features.spread_array(table(spark, folder, "embeddings"), "embedding", EMBEDDING_SIZE)


def rounded_credit(spark: SparkSession, folder: str) -> DataFrame:
    """Standardised credit features on which both engines agree."""
    return features.standardize(written_profile(spark, folder).select("ID", "nivel_riesgo", *FEATURES), FEATURES, digits=6)


def credit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return features.assemble(rounded_credit(spark, folder).select("ID", *FEATURES), FEATURES).select("ID", "features")


def part_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return features.assemble(scaled_parts(spark, folder).select("p_partkey", *PART), PART)


SCALED_PARTS = scaled_sql("part", PART, "p_partkey, p_type", "parts")


# --- SQL building blocks -------------------------------------------------------------------


def elimination(p: int, keep: str, source: str = "sys0", name: str = "sys") -> str:
    """Gauss-Jordan steps as CTEs: ``source`` holds a_i_j and b_i, the last one the solution in b_i."""
    steps = []
    for k in range(p):
        cols = []
        for i in range(p):
            for j in range(p):
                cols.append(f"a_{k}_{j} / a_{k}_{k} AS a_{k}_{j}" if i == k else f"a_{i}_{j} - a_{i}_{k} * a_{k}_{j} / a_{k}_{k} AS a_{i}_{j}")
            cols.append(f"b_{k} / a_{k}_{k} AS b_{k}" if i == k else f"b_{i} - a_{i}_{k} * b_{k} / a_{k}_{k} AS b_{i}")
        steps.append(f"{name}{k + 1} AS (SELECT {keep}, {', '.join(cols)} FROM {source if k == 0 else f'{name}{k}'})")
    return ", ".join(steps)


def regression_sql(columns: list[str], target: str) -> str:
    p = len(columns)
    first = [f"covar_pop({a}, {b}) AS a_{i}_{j}" for i, a in enumerate(columns) for j, b in enumerate(columns)]
    first += [f"covar_pop({a}, {target}) AS b_{i}" for i, a in enumerate(columns)]
    first += [f"covar_pop({a}, {target}) AS c_{i}" for i, a in enumerate(columns)]
    first += [f"avg({a}) AS m_{i}" for i, a in enumerate(columns)]
    keep = ", ".join(["my", "vy"] + [f"c_{i}" for i in range(p)] + [f"m_{i}" for i in range(p)])
    r2 = "(" + " + ".join(f"b_{i} * c_{i}" for i in range(p)) + ") / vy"
    terms = ["'intercept'"] + [f"'{c}'" for c in columns]
    values = ["my - (" + " + ".join(f"b_{i} * m_{i}" for i in range(p)) + ")"] + [f"b_{i}" for i in range(p)]
    return on_credit(
        f"SELECT unnest([{', '.join(terms)}]) AS term, round(unnest([{', '.join(values)}]), 4) AS coefficient, round({r2}, 4) AS r2 FROM sys{p}",
        f"sys0 AS (SELECT avg({target}) AS my, var_pop({target}) AS vy, {', '.join(first)} FROM order_profile)", elimination(p, keep),
    )


def discriminant_ctes(columns: list[str], target: str, source: str = "", key: str = '"ID"', name: str = "predicted") -> list[str]:
    """Without a ``source`` of standardised rows, they are those of the credit table."""
    p = len(columns)
    grid = [(i, j) for i in range(p) for j in range(p)]
    cls = [f"avg({c}) AS m_{i}" for i, c in enumerate(columns)] + [f"covar_pop({columns[i]}, {columns[j]}) AS c_{i}_{j}" for i, j in grid]
    keep = ", ".join(["cls", "n", "total"] + [f"m_{i}" for i in range(p)])
    score = " + ".join(f"{c} * b_{i}" for i, c in enumerate(columns)) + " - 0.5 * (" + " + ".join(f"m_{i} * b_{i}" for i in range(p)) + ") + ln(n / total)"
    return [
        *([] if source else [scaled_sql("order_profile", columns, f'"ID", {target}')]),
        f"per_class AS (SELECT {target} AS cls, count(*) AS n, {', '.join(cls)} FROM {source or 'scaled'} GROUP BY {target})",
        f"pooled AS (SELECT sum(n) AS total, {', '.join(f'sum(n * c_{i}_{j}) / (sum(n) - count(*)) AS a_{i}_{j}' for i, j in grid)} FROM per_class)",
        f"sys0 AS (SELECT cls, n, total, {', '.join(f'm_{i}, m_{i} AS b_{i}' for i in range(p))}, {', '.join(f'a_{i}_{j}' for i, j in grid)} FROM per_class, pooled)",
        elimination(p, keep),
        f"{name} AS (SELECT {key}, any_value({target}) AS {target}, arg_max(cls, {score}) AS prediction FROM {source or 'scaled'}, sys{p} GROUP BY {key})",
    ]


NEWTON_STEPS = 8


def logistic_ctes(columns: list[str], target: str, steps: int = NEWTON_STEPS) -> list[str]:
    """Newton steps of a logistic regression with half the squared weights as penalty, unrolled.

    The weight of the constant comes last and goes without penalty.
    """
    p = len(columns) + 1
    terms = [*columns, "1.0"]
    out = [scaled_sql("order_profile", columns, f'"ID", {target} AS y'), f"w0 AS (SELECT {', '.join(f'0.0::DOUBLE AS w_{i}' for i in range(p))})"]
    score = " + ".join(f"{t} * w_{i}" for i, t in enumerate(terms))
    for k in range(steps):
        a = [
            f"sum(v * {terms[i]} * {terms[j]})" + (" + 1" if i == j and i < p - 1 else "") + f" AS a_{i}_{j}" for i in range(p) for j in range(p)
        ]
        b = [f"sum((y - pr) * {terms[i]})" + (f" - any_value(w_{i})" if i < p - 1 else "") + f" AS b_{i}" for i in range(p)]
        keep = [f"w_{i}" for i in range(p)]
        out += [
            f"pr{k} AS (SELECT *, pr * (1 - pr) AS v FROM (SELECT *, 1 / (1 + exp(-({score}))) AS pr FROM scaled, w{k}))",
            f"n{k}_0 AS (SELECT {', '.join(a + b)}, {', '.join(f'any_value({w}) AS {w}' for w in keep)} FROM pr{k})",
            elimination(p, ", ".join(keep), f"n{k}_0", f"n{k}_"),
            f"w{k + 1} AS (SELECT {', '.join(f'w_{i} + b_{i} AS w_{i}' for i in range(p))} FROM n{k}_{p})",
        ]
    return [*out, f"judged AS (SELECT avg(CASE WHEN ({score} > 0) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM scaled, w{steps})"]


def component_ctes(columns: list[str]) -> list[str]:
    """Leading two eigenvectors of the correlation matrix by repeated squaring and deflation."""
    z = [f"(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()) AS {c}" for c in columns]
    matrix = "[" + ", ".join("[" + ", ".join(f"corr({a}, {b})" for b in columns) + "]" for a in columns) + "]"
    square = "list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c)))"
    trace = "list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i]))"
    shrink = f"list_transform(m, lambda r: list_transform(r, lambda x: x / {trace}))"
    lead = "m[list_position(list_transform(range(1, len(m) + 1), lambda i: m[i][i]), list_max(list_transform(range(1, len(m) + 1), lambda i: m[i][i])))]"
    ctes = [f'z AS (SELECT "ID", {", ".join(z)} FROM order_profile)', f"m0 AS (SELECT {matrix} AS m FROM z)"]
    for k, source in ((1, "m0"), (2, "m1")):
        ctes += [
            f"pow{k}(i, m) AS (SELECT 0, m FROM {source} UNION ALL SELECT i + 1, {shrink} FROM (SELECT i, {square} AS m FROM pow{k} WHERE i < 40))",
            f"raw{k} AS (SELECT {lead} AS w FROM pow{k} WHERE i = 40)",
            f"""vec{k} AS (SELECT list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))
                * sign(w[list_position(list_transform(w, lambda y: abs(y)), list_max(list_transform(w, lambda y: abs(y))))])) AS v FROM raw{k})""",
        ]
        if k == 1:
            ctes.append("""m1 AS (SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j:
                m[i][j] - v[i] * v[j] * list_dot_product(list_transform(m, lambda r: list_dot_product(r, v)), v))) AS m FROM m0, vec1)""")
    return ctes


NEAREST = """ranked AS (SELECT q.{key} AS id, q.{label} AS label, r.{label} AS near,
  row_number() OVER (PARTITION BY q.{key} ORDER BY {distance}, r.{key}) AS place FROM {t} q, {t} r),
votes AS (SELECT id, label, near, count(*) AS n FROM ranked WHERE place <= 5 GROUP BY ALL),
predicted AS (SELECT id AS {key}, label AS {label}, near AS prediction FROM votes
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, near) = 1)"""
PART_GAP2 = "((q.p_size - r.p_size) * (q.p_size - r.p_size) + (q.p_retailprice - r.p_retailprice) * (q.p_retailprice - r.p_retailprice))"

def density_ctes(source: str, columns: list[str], key: str, eps: float) -> str:
    """Neighbour pairs, core rows, reachability and the smallest-core numbering."""
    near = " + ".join(f"(q.{c} - r.{c}) * (q.{c} - r.{c})" for c in columns)
    return f"""near AS MATERIALIZED (SELECT q.{key} AS a, r.{key} AS b FROM {source} q, {source} r WHERE {near} <= {eps * eps!r}),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5),
links AS (SELECT a, b FROM near SEMI JOIN core ON a = core.id SEMI JOIN core AS other ON b = other.id),
reach(root, id) AS (SELECT id, id FROM core UNION SELECT root, b FROM reach JOIN links ON reach.id = links.a),
component AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
numbered AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM component),
edge AS (SELECT a, min(cluster) AS cluster FROM near JOIN numbered ON near.b = numbered.id GROUP BY a),
labelled AS (SELECT s.{key}, CAST(coalesce(own.cluster, edge.cluster, -1) AS INTEGER) AS cluster
  FROM {source} s LEFT JOIN numbered own ON own.id = s.{key} LEFT JOIN edge ON edge.a = s.{key})"""


def density_sql(source: str, columns: list[str], key: str, eps: float, result: str, *ctes: str) -> str:
    return with_ctes(result, *ctes, density_ctes(source, columns, key, eps)).replace("WITH", "WITH RECURSIVE", 1)


MEDOID_STEPS = 12


def medoid_ctes(steps: int = MEDOID_STEPS) -> list[str]:
    """Alternating assignment and exact medoids, unrolled; extra steps change nothing."""
    out = [
        f"""med0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY total, id) - 1 AS g, id, p_size, p_retailprice FROM (
            SELECT q.p_partkey AS id, any_value(q.p_size) AS p_size, any_value(q.p_retailprice) AS p_retailprice, sum(sqrt({PART_GAP2})) AS total
            FROM parts q, parts r GROUP BY q.p_partkey ORDER BY total, id LIMIT 3))"""
    ]
    for k in range(steps):
        gap = PART_GAP2.replace("r.", "m.")
        out += [
            f"asg{k} AS MATERIALIZED (SELECT q.p_partkey, q.p_size, q.p_retailprice, arg_min(m.g, ({gap}, m.g)) AS g FROM parts q, med{k} m GROUP BY ALL)",
            f"""tot{k} AS MATERIALIZED (SELECT q.g, q.p_partkey AS id, q.p_size, q.p_retailprice, sum(sqrt({PART_GAP2})) AS total
                FROM asg{k} q JOIN asg{k} r ON q.g = r.g GROUP BY ALL)""",
            f"""med{k + 1} AS MATERIALIZED (SELECT g, id, p_size, p_retailprice FROM tot{k}
                QUALIFY row_number() OVER (PARTITION BY g ORDER BY total, id) = 1)""",
        ]
    return out


def gap2(columns: list[str], a: str = "q", b: str = "c") -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in columns)


def kmeans_ctes(source: str, columns: list[str], key: str, last: int) -> list[str]:
    """Centres c1 .. c{last}, lists of lists, one set after the other; each is moved by recursion until it is settled.

    near{k + 1} has every row with the number of its centre of c{k} and the squared distance to it.
    """
    x = f"[{', '.join(columns)}]::DOUBLE[]"
    gaps = "list_transform(cs, lambda c: list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
    out = [
        f"vectors AS MATERIALIZED (SELECT {key} AS id, {x} AS x FROM {source})",
        f"starts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), CAST(id AS VARCHAR)) AS o, x AS start FROM vectors QUALIFY o <= {models.STARTS})",
        f"still AS MATERIALIZED (SELECT {models.MOVE!r} * ({' + '.join(f'var_pop({c})' for c in columns)}) / {len(columns)} AS move FROM {source})",
        f"c1 AS MATERIALIZED (SELECT [[{', '.join(f'avg({c})' for c in columns)}]] AS cs FROM {source})",
    ]

    def near(k: int) -> str:
        return f"""near{k + 1} AS MATERIALIZED (SELECT id AS {key}, x, list_position(ds, list_min(ds)) - 1 AS g, list_min(ds) AS d
            FROM (SELECT id, x, {gaps} AS ds FROM vectors, c{k}))"""

    means = ", ".join(f"avg(x[{j + 1}])" for j in range(len(columns)))
    for k in range(2, last + 1):
        out += [
            near(k - 1),
            f"""pick{k} AS MATERIALIZED (SELECT arg_min(start, (cost, o)) AS start FROM (
                SELECT o, any_value(start) AS start, sum(least(d, list_sum(list_transform(list_zip(x, start), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS cost FROM near{k}, starts GROUP BY o))""",
            f"""steps{k}(i, cs) AS (SELECT 0, list_append(cs, start) FROM c{k - 1}, pick{k} UNION ALL
                SELECT i + 1, list_transform(range(0, len(cs)), lambda g: coalesce(moved[g], cs[g + 1])) FROM (
                  SELECT i, any_value(cs) AS cs, map(list(g ORDER BY g), list(m ORDER BY g)) AS moved FROM (
                    SELECT i, any_value(cs) AS cs, g, [{means}] AS m FROM (SELECT i, cs, x, list_position(ds, list_min(ds)) - 1 AS g FROM (SELECT i, cs, x, {gaps} AS ds FROM steps{k}, vectors)) GROUP BY i, g)
                  GROUP BY i), still
                WHERE list_sum(list_transform(range(0, len(cs)), lambda g: list_sum(list_transform(list_zip(coalesce(moved[g], cs[g + 1]), cs[g + 1]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) > move)""",
            f"c{k} AS MATERIALIZED (SELECT arg_max(cs, i) AS cs FROM steps{k})",
        ]
    return [*out, near(last)]


MIXTURE_STEPS = 12


def mixture_ctes(source: str, x: str, y: str, key: str, start: str, steps: int = MIXTURE_STEPS) -> list[str]:
    """Mixture of two features, from the clusters in ``start``: parameters and rows of each step, labels of the settled one."""
    out = [f"r0 AS MATERIALIZED (SELECT {key}, {x}, {y}, o.g, CASE WHEN q.g = o.g THEN 1.0 ELSE 0.0 END AS r FROM {start} q JOIN {source} USING ({key}), (SELECT DISTINCT g FROM {start}) o)"]
    for s in range(steps):
        out += [
            f"e{s} AS MATERIALIZED (SELECT g, sum(r) AS n, sum(r * {x}) / sum(r) AS mx, sum(r * {y}) / sum(r) AS my FROM r{s} GROUP BY g)",
            f"""p{s} AS MATERIALIZED (SELECT g, any_value(e.n) AS n, any_value(e.mx) AS mx, any_value(e.my) AS my,
                sum(r * ({x} - e.mx) * ({x} - e.mx)) / any_value(e.n) + {models.RIDGE!r} AS sxx, sum(r * ({y} - e.my) * ({y} - e.my)) / any_value(e.n) + {models.RIDGE!r} AS syy,
                sum(r * ({x} - e.mx) * ({y} - e.my)) / any_value(e.n) AS sxy FROM r{s} JOIN e{s} e USING (g) GROUP BY g)""",
            f"""l{s} AS MATERIALIZED (SELECT {key}, {x}, {y}, g, ln(n / (SELECT count(*) FROM {source})) - ln(2 * pi()) - 0.5 * ln(sxx * syy - sxy * sxy)
                - 0.5 * (syy * ({x} - mx) * ({x} - mx) - 2 * sxy * ({x} - mx) * ({y} - my) + sxx * ({y} - my) * ({y} - my)) / (sxx * syy - sxy * sxy) AS lp
                FROM (SELECT DISTINCT {key}, {x}, {y} FROM r{s}), p{s})""",
            f"t{s} AS MATERIALIZED (SELECT {key}, max(lp) + ln(sum(exp(lp - top))) AS ll, arg_max(g, (lp, -g)) AS g FROM (SELECT *, max(lp) OVER (PARTITION BY {key}) AS top FROM l{s}) GROUP BY {key})",
            f"r{s + 1} AS MATERIALIZED (SELECT l.{key}, l.{x}, l.{y}, l.g, exp(l.lp - t.ll) AS r FROM l{s} l JOIN t{s} t USING ({key}))",
        ]
    gains = " UNION ALL ".join(f"SELECT {s} AS s, abs((SELECT avg(ll) FROM t{s}) - (SELECT avg(ll) FROM t{s - 1})) AS gain" for s in range(1, steps))
    labels = " UNION ALL ".join(f"SELECT {s} AS s, {key}, g FROM t{s}" for s in range(1, steps))
    return [*out, f"gains AS ({gains})", f"mixed AS MATERIALIZED (SELECT {key}, g AS cluster FROM ({labels}) WHERE s = (SELECT min(s) FROM gains WHERE gain < {models.GAIN!r}))"]


def silhouette_ctes(labelled: str, columns: list[str], key: str, name: str) -> list[str]:
    """{name}: rows_scored and silhouette of ``labelled`` (key, cluster, columns) under Euclidean distance."""
    return [
        f"{name}_sums AS MATERIALIZED (SELECT q.{key} AS id, q.cluster AS own, c.cluster AS k, count(*) AS n, sum(sqrt({gap2(columns)})) AS total FROM {labelled} q, {labelled} c GROUP BY ALL)",
        f"""{name}_sides AS (SELECT id, max(n) FILTER (WHERE k = own) AS n, max(total / nullif(n - 1, 0)) FILTER (WHERE k = own) AS a,
            min(total / n) FILTER (WHERE k <> own) AS b FROM {name}_sums GROUP BY id)""",
        f"""{name} AS (SELECT count(*) AS rows_scored, CASE WHEN count(b) > 0 THEN avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) END AS silhouette
            FROM {name}_sides)""",
    ]


# --- queries -------------------------------------------------------------------------------


@query("m1_features_target", on_credit('SELECT "ID", nivel_riesgo, ' + ", ".join(f"CAST({c} AS DOUBLE) AS f{i}" for i, c in enumerate(FEATURES)) + " FROM order_profile"))
def features_target(spark: SparkSession, folder: str) -> DataFrame:
    data = features.assemble(written_profile(spark, folder), FEATURES).withColumn("f", vector_to_array("features"))
    return data.select("ID", "nivel_riesgo", *[F.col("f")[i].alias(f"f{i}") for i in range(len(FEATURES))])


@query("m2_standardize", on_credit('SELECT "ID", nivel_riesgo, delincuencia_reciente, ' + ", ".join(f"{c} + 0.0 AS {c}" for c in FEATURES) + " FROM scaled",
                                   scaled_sql("order_profile", FEATURES, '"ID", nivel_riesgo, delincuencia_reciente')))
def standardize(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scaled_credit(spark, folder))


@query("m3_principal_components", on_credit(
    f"""SELECT "ID", round(list_dot_product([{', '.join(FEATURES)}], vec1.v), 6) + 0.0 AS pc1,
    round(list_dot_product([{', '.join(FEATURES)}], vec2.v), 6) + 0.0 AS pc2 FROM z, vec1, vec2""", *component_ctes(FEATURES)).replace("WITH", "WITH RECURSIVE", 1))
def principal_components(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(models.principal_components(scaled_credit(spark, folder), FEATURES, ["ID"]))


@query("m4_elbow", on_credit(
    " UNION ALL ".join(f"SELECT {k} AS k, round(sum(d), 4) AS inertia FROM near{k + 1}" for k in models.ELBOW_RANGE),
    scaled_sql("order_profile", FEATURES, '"ID"'), *kmeans_ctes("scaled", FEATURES, '"ID"', models.ELBOW_RANGE.stop - 1)).replace("WITH", "WITH RECURSIVE", 1))
def elbow(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(models.elbow(credit_vectors(spark, folder), "ID"), 4)


_SPREAD = " + ".join(f"var_pop({c})" for c in FEATURES)


@query("m4_elbow_facts", on_credit(
    f"""SELECT k, true AS falling, true AS below_total, round({_SPREAD}, 4) AS total_per_row
    FROM (SELECT unnest(range({models.ELBOW_RANGE.start}, {models.ELBOW_RANGE.stop}))::INTEGER AS k) ks, scaled GROUP BY k""",
    scaled_sql("order_profile", FEATURES, '"ID"')))
def elbow_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the curve: each cost is below the one before, and all below the total spread."""
    rows = materialize(scaled_credit(spark, folder), "scaled")
    curve = models.elbow(features.assemble(rows.select("ID", *FEATURES), FEATURES), "ID")
    spread = rows.agg(sum((F.var_pop(c) for c in FEATURES), F.lit(0.0)).alias("total"), F.count("*").alias("n")).first()
    # one row per k: the window is as small as the range asked for
    before = F.coalesce(F.lag("inertia").over(Window.partitionBy(F.lit(0)).orderBy("k")), F.lit(spread["total"] * spread["n"]))
    return curve.select(
        "k", (F.col("inertia") < before).alias("falling"), (F.col("inertia") < spread["total"] * spread["n"]).alias("below_total"),
        F.lit(round(spread["total"], 4)).alias("total_per_row"),
    )


@query("m5_simple_regression", on_credit("""SELECT round(regr_slope(ingreso_mensual, edad), 6) AS slope, round(regr_intercept(ingreso_mensual, edad), 6) AS intercept,
round(regr_r2(ingreso_mensual, edad), 6) AS r2 FROM order_profile"""))
def simple_regression(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(models.simple_regression(order_profile(spark, folder), "edad", "ingreso_mensual"))


@query("m6_multiple_regression_four", regression_sql(FOUR, "ingreso_mensual"))
def multiple_regression_four(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(models.multiple_regression(written_profile(spark, folder), FOUR, "ingreso_mensual"), 4)


@query("m6_multiple_regression_all", regression_sql([*REST, "delincuencia_reciente"], "ingreso_mensual"))
def multiple_regression_all(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(models.multiple_regression(written_profile(spark, folder), [*REST, "delincuencia_reciente"], "ingreso_mensual"), 4)


@query("m7_neighbours_part", with_ctes("SELECT * FROM predicted", SCALED_PARTS, NEAREST.format(key="p_partkey", label="p_type", t="parts", distance=PART_GAP2)))
def neighbours_part(spark: SparkSession, folder: str) -> DataFrame:
    return neighbors.knn_predict(scaled_parts(spark, folder), PART, "p_type", "p_partkey")


@query("m7_neighbours_embeddings", with_ctes("SELECT * FROM predicted", "vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)",
       NEAREST.format(key="vec_id", label="label", t="vectors", distance="list_distance(q.e, r.e)")))
def neighbours_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return neighbors.knn_predict(embedded(spark, folder), EMBEDDED, "label", "vec_id")


_CREDIT_GAP2 = " + ".join(f"(q.{c} - r.{c}) * (q.{c} - r.{c})" for c in FEATURES)


@query("m7_neighbours_credit", on_credit(
    """SELECT id AS "ID", label AS nivel_riesgo, near AS prediction FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, near) = 1""",
    scaled_sql("order_profile", FEATURES, '"ID", nivel_riesgo'),
    f"""closest AS (SELECT q."ID" AS id, q.nivel_riesgo AS label, min({{'d': {_CREDIT_GAP2}, 'id': r."ID", 'near': r.nivel_riesgo}}, 5) AS five
        FROM scaled q, scaled r GROUP BY q."ID", q.nivel_riesgo)""",
    "votes AS (SELECT id, label, one.near AS near, count(*) AS n FROM (SELECT id, label, unnest(five) AS one FROM closest) GROUP BY ALL)"))
def neighbours_credit(spark: SparkSession, folder: str) -> DataFrame:
    rows = written_profile(spark, folder).select("ID", "nivel_riesgo", *FEATURES)
    return neighbors.knn_predict(features.standardize(rows, FEATURES, digits=6), FEATURES, "nivel_riesgo", "ID")


@query("m8_logistic_binary", on_credit("SELECT accuracy, '' AS note FROM judged", *logistic_ctes(FEATURES, "delincuencia_reciente")))
def logistic_binary(spark: SparkSession, folder: str) -> DataFrame:
    return models.logistic_accuracy(scaled_credit(spark, folder), FEATURES, "delincuencia_reciente")


@query("m8_logistic_tiers", on_credit("SELECT NULL::DOUBLE AS accuracy, 'No aplica' AS note FROM order_profile HAVING count(DISTINCT nivel_riesgo) <> 2"))
def logistic_tiers(spark: SparkSession, folder: str) -> DataFrame:
    return models.logistic_accuracy(scaled_credit(spark, folder), FEATURES, "nivel_riesgo")


@query("m9_discriminant", on_credit("SELECT nivel_riesgo, prediction, count(*) AS n FROM predicted GROUP BY ALL", *discriminant_ctes(FEATURES, "nivel_riesgo")))
def discriminant(spark: SparkSession, folder: str) -> DataFrame:
    predicted = models.discriminant_predict(scaled_credit(spark, folder), FEATURES, "nivel_riesgo")
    return models.confusion(predicted, "nivel_riesgo")


@query("m10_kmeans", on_credit('SELECT "ID", g AS cluster FROM near4', scaled_sql("order_profile", FEATURES, '"ID"'), *kmeans_ctes("scaled", FEATURES, '"ID"', models.CLUSTERS)).replace("WITH", "WITH RECURSIVE", 1))
def kmeans(spark: SparkSession, folder: str) -> DataFrame:
    return models.kmeans_labels(credit_vectors(spark, folder), "ID").select("ID", "cluster")


_CLUSTER_FACTS = "SELECT count(*) AS n_rows, {k} AS clusters, 0::BIGINT AS {fault} FROM order_profile"


@query("m10_kmeans_facts", on_credit(_CLUSTER_FACTS.format(k=models.CLUSTERS, fault="misplaced")))
def kmeans_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the clusters: every row has one, none is empty, and its mean is the nearest one.

    A fit ends when its centres move less than its tolerance, so a row counts as misplaced only if
    another mean is nearer by more than that.
    """
    rows = rounded_credit(spark, folder).select("ID", *FEATURES)
    labelled = materialize(models.kmeans_labels(features.assemble(rows, FEATURES), "ID").drop("features"), "labelled")
    means = labelled.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in FEATURES]).orderBy("cluster").collect()
    to = F.array(*[sum(((F.col(c) - m[c]) * (F.col(c) - m[c]) for c in FEATURES), F.lit(0.0)) for m in means])
    own = F.element_at(to, F.array_position(F.array(*[F.lit(m["cluster"]) for m in means]), F.col("cluster")).cast("int"))
    return labelled.agg(
        F.count("*").alias("n_rows"), F.count_distinct("cluster").cast("int").alias("clusters"),
        F.count_if(F.sqrt(own) > F.sqrt(F.array_min(to)) + 0.05).alias("misplaced"),
    )


@query("m11_medoids", with_ctes(f"""SELECT p_partkey, CAST(a.g AS INTEGER) AS cluster, m.id AS medoid FROM asg{MEDOID_STEPS - 1} a JOIN med{MEDOID_STEPS} m ON a.g = m.g""",
                                SCALED_PARTS, *medoid_ctes()))
def medoid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return medoids.medoid_labels(scaled_parts(spark, folder), PART, "p_partkey").select("p_partkey", "cluster", "medoid")


@query("m12_density", density_sql("parts", PART, "p_partkey", PART_EPS, "SELECT * FROM labelled", SCALED_PARTS))
def density_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return density.dbscan(scaled_parts(spark, folder), PART, "p_partkey", eps=PART_EPS, min_samples=5)


@query("m12_density_credit", density_sql("scaled", FEATURES, '"ID"', 0.5, "SELECT * FROM labelled", CREDIT_SQL, scaled_sql("order_profile", FEATURES, '"ID"')))
def density_credit(spark: SparkSession, folder: str) -> DataFrame:
    scaled = features.standardize(written_profile(spark, folder).select("ID", *FEATURES), FEATURES, digits=6)
    return density.dbscan(scaled, FEATURES, "ID", eps=0.5, min_samples=5)


@query("p12_without_noise", density_sql("parts", PART, "p_partkey", PART_EPS, "SELECT * FROM labelled WHERE cluster <> -1", SCALED_PARTS))
def without_noise(spark: SparkSession, folder: str) -> DataFrame:
    return clean.without_noise(density.dbscan(scaled_parts(spark, folder), PART, "p_partkey", eps=PART_EPS, min_samples=5))


@query("m13_mixture")
def mixture(spark: SparkSession, folder: str) -> DataFrame:
    return models.mixture_labels(credit_vectors(spark, folder), "ID").select("ID", "cluster")


@query("m13_mixture_part", with_ctes("SELECT p_partkey, cluster FROM mixed", SCALED_PARTS, *kmeans_ctes("parts", PART, "p_partkey", models.CLUSTERS),
                                     *mixture_ctes("parts", *PART, "p_partkey", "near4")).replace("WITH", "WITH RECURSIVE", 1))
def mixture_part(spark: SparkSession, folder: str) -> DataFrame:
    return models.mixture_labels(part_vectors(spark, folder), "p_partkey").select("p_partkey", "cluster")


@query("m13_mixture_facts", on_credit(_CLUSTER_FACTS.format(k=models.CLUSTERS, fault="without_cluster")))
def mixture_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the labels: one of each row, in the range of the mixture's components, and none of these without a row."""
    labelled = models.mixture_labels(credit_vectors(spark, folder), "ID").select("ID", "cluster")
    valid = F.col("cluster").between(0, models.CLUSTERS - 1)
    return labelled.agg(
        F.count_distinct("ID").alias("n_rows"), F.count_distinct("cluster").cast("int").alias("clusters"),
        F.coalesce(F.sum((~F.coalesce(valid, F.lit(False))).cast("bigint")), F.lit(0)).alias("without_cluster"),
    )


_TIER_CODE = "CASE nivel_riesgo WHEN 'Alto' THEN 0 WHEN 'Bajo' THEN 1 WHEN 'Medio' THEN 2 ELSE 3 END"
_SQUARE = " + ".join(f"{c} * {c}" for c in FEATURES)


@query("m14_silhouette_squared", on_credit(
    "SELECT 'squared' AS metric, count(*) AS rows_scored, round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM sides",
    scaled_sql("order_profile", FEATURES, f'"ID", {_TIER_CODE} AS k'),
    f"sums AS (SELECT k, count(*) AS n, sum({_SQUARE}) AS q, {', '.join(f'sum({c}) AS s_{c}' for c in FEATURES)} FROM scaled GROUP BY k)",
    f"""gaps AS (SELECT r."ID", r.k AS own, s.k, s.n, ({' + '.join(f'r.{c} * r.{c}' for c in FEATURES)}) * s.n + s.q
        - 2 * ({' + '.join(f'r.{c} * s.s_{c}' for c in FEATURES)}) AS total FROM scaled r, sums s)""",
    """sides AS (SELECT "ID", max(n) FILTER (WHERE k = own) AS n, max(total / nullif(n - 1, 0)) FILTER (WHERE k = own) AS a,
        min(total / n) FILTER (WHERE k <> own) AS b FROM gaps GROUP BY "ID")"""))
def silhouette_squared(spark: SparkSession, folder: str) -> DataFrame:
    rows = features.category_codes(rounded(scaled_credit(spark, folder)), ["nivel_riesgo"])
    return rounded(silhouette.silhouette_squared(materialize(rows, "scored"), FEATURES, "nivel_riesgo"))


@query("m14_silhouette_euclidean", on_credit(
    "SELECT 'euclidean' AS metric, rows_scored, round(silhouette, 6) AS silhouette FROM scored",
    scaled_sql("order_profile", FEATURES, f'"ID", {_TIER_CODE} AS cluster'), *silhouette_ctes("scaled", FEATURES, '"ID"', "scored")))
def silhouette_euclidean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(silhouette.silhouette_euclidean(rounded_credit(spark, folder), FEATURES, "nivel_riesgo"))


@query("m15_accuracy", on_credit("SELECT round(avg(CASE WHEN nivel_riesgo = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM predicted",
                                 *discriminant_ctes(FEATURES, "nivel_riesgo")))
def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    predicted = models.discriminant_predict(scaled_credit(spark, folder), FEATURES, "nivel_riesgo")
    return rounded(models.accuracy(predicted, "nivel_riesgo", "prediction"))


ALL_METRICS = ("r2", "accuracy", "silhouette")


def comparison(spark: SparkSession, folder: str, metrics: tuple[str, ...] = ALL_METRICS) -> DataFrame:
    scaled = materialize(scaled_parts(spark, folder), "scaled-parts")
    return rounded(report.compare_models(parts(spark, folder), scaled, PART, "p_partkey", "p_type", "p_size", "p_retailprice", eps=PART_EPS, metrics=metrics))


_CLUSTERINGS = {
    5: f"SELECT p_partkey, g AS cluster, {', '.join(PART)} FROM near4 JOIN parts USING (p_partkey)",
    6: f"SELECT p_partkey, g AS cluster, {', '.join(PART)} FROM asg{MEDOID_STEPS}",
    7: f"SELECT p_partkey, cluster, {', '.join(PART)} FROM mixed JOIN parts USING (p_partkey)",
    8: f"SELECT p_partkey, cluster, {', '.join(PART)} FROM labelled JOIN parts USING (p_partkey) WHERE cluster <> -1",
}
_ACCURACY = "SELECT avg(CASE WHEN p_type = prediction THEN 1.0 ELSE 0.0 END) FROM {}"
_SCORES = {
    0: "SELECT regr_r2(p_retailprice, p_size) FROM part",
    1: "SELECT regr_r2(p_retailprice, p_size) FROM part",
    2: "SELECT NULL::DOUBLE",
    3: _ACCURACY.format("discriminated"),
    4: _ACCURACY.format("predicted"),
    **{k: f"SELECT silhouette FROM sil{k}" for k in _CLUSTERINGS},
}


def comparison_ctes(wanted: list[int]) -> list[str]:
    """compared: the report's lines of these models."""
    gap = PART_GAP2.replace("r.", "m.")
    out = [SCALED_PARTS]
    if 3 in wanted:
        out += discriminant_ctes(PART, "p_type", "parts", "p_partkey", "discriminated")
    if 4 in wanted:
        out.append(NEAREST.format(key="p_partkey", label="p_type", t="parts", distance=PART_GAP2))
    if 5 in wanted:
        out += [
            *kmeans_ctes("parts", PART, "p_partkey", models.CLUSTERS), *medoid_ctes(),
            f"asg{MEDOID_STEPS} AS MATERIALIZED (SELECT q.p_partkey, q.p_size, q.p_retailprice, arg_min(m.g, ({gap}, m.g)) AS g FROM parts q, med{MEDOID_STEPS} m GROUP BY ALL)",
            *mixture_ctes("parts", *PART, "p_partkey", "near4"), density_ctes("parts", PART, "p_partkey", PART_EPS),
        ]
        for k, rows in _CLUSTERINGS.items():
            out += [f"lab{k} AS MATERIALIZED ({rows})", *silhouette_ctes(f"lab{k}", PART, "p_partkey", f"sil{k}")]
    lines = [f"({i}, '{report.MODELS[i][0]}', '{report.MODELS[i][1]}', ({_SCORES[i]}))" for i in wanted]
    return [*out, f"""compared AS (SELECT ord::INTEGER AS ord, model, metric, round(score, 6) AS score, CASE WHEN score IS NULL THEN '{report.NOT_APPLICABLE}' ELSE '' END AS note
        FROM (VALUES {', '.join(lines)}) AS lines(ord, model, metric, score))"""]


def comparison_sql(select: str, wanted: list[int]) -> str:
    return with_ctes(select, *comparison_ctes(wanted)).replace("WITH", "WITH RECURSIVE", 1)


@query("m16_model_comparison", comparison_sql("SELECT * FROM compared", list(_SCORES)))
def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return comparison(spark, folder)


@query("m16_best_model", comparison_sql("SELECT * FROM compared WHERE score IS NOT NULL ORDER BY score DESC, ord LIMIT 1", list(_CLUSTERINGS)))
def best_model(spark: SparkSession, folder: str) -> DataFrame:
    return report.best_model(comparison(spark, folder, ("silhouette",)))


@query("m16_comparison_facts", comparison_sql("SELECT ord, model, metric, score, note, true AS in_range FROM compared", list(_SCORES)))
def comparison_facts(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of the comparison, each score in its range."""
    low = F.when(F.col("metric") == "silhouette", -1.0).otherwise(0.0)
    lines = comparison(spark, folder)
    return lines.select("ord", "model", "metric", "score", "note", F.coalesce(F.col("score").between(low, F.lit(1.0)), F.lit(True)).alias("in_range"))


@query("s7_report", on_credit("""SELECT count(*) AS lines, CAST(sum(n) AS BIGINT) AS n FROM (
SELECT count(*) AS n FROM order_profile GROUP BY nivel_riesgo UNION ALL SELECT count(*) FROM order_profile GROUP BY num_dependientes)"""))
def written_report(spark: SparkSession, folder: str) -> DataFrame:
    view = written_profile(spark, folder)
    counts = {
        name: view.groupBy(F.col(name).cast("string").alias("value")).agg(F.count("*").alias("n"))
        for name in ("nivel_riesgo", "num_dependientes")
    }
    paths = report.write_report(counts, new_path(spark, "report"))
    return spark.read.parquet(*paths.values()).agg(F.count("*").alias("lines"), F.sum("n").alias("n"))
