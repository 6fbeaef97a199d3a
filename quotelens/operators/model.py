"""Win-probability model: grouped split, weights, preprocessing, logistic fit.

Preprocessing statistics are exact medians and population moments, learned
with aggregations.  The logistic model is fitted by Newton's method with the
product block of the Hessian eliminated, one aggregation per step.  The fitted
model is a few numbers and a table of product coefficients: rows to be scored
get their product's coefficient by a lookup join, the rest is a Column
expression, which also prices the margin grid row by row.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    DECISION_THRESHOLD,
    LOGREG_C,
    LOGREG_MAX_ITER,
    NUMERIC_FEATURES,
    SPLIT_SEED,
    SPLIT_TEST_SIZE,
)
from ..plans.scorecard import MARGIN_VARYING, sigmoid
from ..session import is_grouped, materialize
from .cleaning import select_features
from .keyed import exact_medians, lookup_join, null_safe_join, running_totals, with_key_stats

SPLIT_FEW = 1000   # hashes the split's selection ends with on the driver
PRODUCTS_AT_ONCE = 100_000   # products a task of the fit holds sums of before it writes them
PRODUCTS_SENT = 100_000      # products whose coefficients go to each task of the fit as they are; more are joined


# ------------------------------------------------------------------ M1
def _split_hash(quote_id: Column, seed: int) -> Column:
    return F.md5(F.concat(quote_id.cast("string"), F.lit(f":{seed}")))


def split_cut(df: DataFrame, test_size: float = SPLIT_TEST_SIZE, seed: int = SPLIT_SEED) -> str:
    """The hash up to which quotes are test quotes: exactly ceil(test_size * quotes) of them.

    Exact distributed selection of the kth smallest hash of '<quote_id>:<seed>':
    counts per hash prefix of four more digits narrow the range (at most 65,536
    counts per round) until a few hashes are left.  Empty without quotes.
    """
    hashes = materialize(df.where(F.col("quote_id").isNotNull()).select(_split_hash(F.col("quote_id"), seed).alias("h"))
                         .distinct(), "split-hashes")
    rank = math.ceil(test_size * hashes.count())   # how many of those still in range are wanted
    prefix, running = "", Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    while rank:
        inside = hashes.where(F.col("h").startswith(prefix))
        few = [r["h"] for r in inside.orderBy("h").limit(SPLIT_FEW + 1).collect()]
        if len(few) <= SPLIT_FEW:
            return few[rank - 1]
        cut = (inside.groupBy(F.substring("h", 1, len(prefix) + 4).alias("p")).agg(F.count(F.lit(1)).alias("n"))
               .withColumn("upto", F.sum("n").over(running)).where(F.col("upto") >= rank).orderBy("p").first())
        prefix, rank = cut["p"], rank - (cut["upto"] - cut["n"])
    return ""


def group_split(df: DataFrame, test_size: float = SPLIT_TEST_SIZE, seed: int = SPLIT_SEED) -> DataFrame:
    """M1: add ``is_test``; exactly ceil(test_size * quotes) quotes are test quotes, no quote is on both sides.

    The cut is found once; the flag itself is row-local.  Lines without a quote id are training lines."""
    h = _split_hash(F.col("quote_id"), seed)
    return df.withColumn("is_test", F.coalesce(h <= F.lit(split_cut(df, test_size, seed)), F.lit(False)))


# ------------------------------------------------------------------ M2 / M3
def quote_weights(df: DataFrame, out: str = "quote_weight") -> DataFrame:
    """1 / (lines of the quote within ``df``): every quote weighs the same (skew-safe count)."""
    if is_grouped(df, "quote_id"):   # a quote's lines already lie together
        return df.withColumn(out, F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("quote_id")))
    w = with_key_stats(df, ["quote_id"], count_col="_lines", keep_count=True)
    return w.withColumn(out, F.lit(1.0) / F.col("_lines")).drop("_lines")


@dataclass
class ClassWeights:
    """'balanced' weights per class: all / (classes * count of the class)."""

    count: dict[int, float]
    weight: dict[int, float]
    total: float   # sum of the sample weights (quote weight x class weight)

    def column(self, label: Column) -> Column:
        out = F.lit(None).cast("double")
        for y, v in self.weight.items():
            out = F.when(label == F.lit(y), F.lit(v)).otherwise(out)
        return out

    def to_lists(self) -> list:
        return [list(self.count.items()), list(self.weight.items()), self.total]

    @staticmethod
    def from_lists(x: list) -> ClassWeights:
        return ClassWeights(dict(map(tuple, x[0])), dict(map(tuple, x[1])), x[2])

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(int(y), int(n), float(self.weight[y])) for y, n in self.count.items()],
                                     "is_win int, n_class long, class_weight double")


def class_weights(weighted: DataFrame, label: str = "is_win", by_weight: bool = False) -> ClassWeights:
    """M3: counts are raw lines; with ``by_weight`` they are sums of the quote weights
    (the other reading of 'balanced' with sample weights).  At most two rows reach the driver."""
    per_class = {r[label]: r for r in weighted.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.sum("quote_weight").alias("s")).collect()}
    amount = {y: (r["s"] if by_weight else r["n"]) for y, r in per_class.items()}
    weight = {y: sum(amount.values()) / (len(amount) * a) for y, a in amount.items()}
    return ClassWeights(amount, weight, sum(weight[y] * r["s"] for y, r in per_class.items()))


# ------------------------------------------------------------------ M4-M6
def product_mode(df: DataFrame) -> DataFrame:
    """M5: most frequent product, ties -> smallest (one row)."""
    counts = df.where(F.col("product").isNotNull()).groupBy("product").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("product")).limit(1).select("product")


@dataclass
class Preprocessing:
    medians: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    product_fill: str | None
    features: list[str] = field(default_factory=list)   # numeric features kept (all-null ones dropped)

    def z(self, f: str, x: Column) -> Column:
        return (F.coalesce(x.cast("double"), F.lit(self.medians[f])) - F.lit(self.means[f])) / F.lit(self.scales[f])

    def product(self, x: Column) -> Column:
        return F.coalesce(x, F.lit(self.product_fill))


def learn_preprocessing(df: DataFrame, features: list[str] = NUMERIC_FEATURES) -> Preprocessing:
    """Learn imputation and scaling on the fit set (M4-M6); a few scalars reach the driver.

    Medians first (exact), then mean and population standard deviation of the
    imputed values in one aggregation (Spark's running moments, which don't cancel).
    """
    row = exact_medians(df, [], {f: f for f in features}).first()
    # all-NULL features are dropped, as scikit-learn does
    medians = {f: float(row[f]) for f in features if row is not None and row[f] is not None}
    if not medians:
        return Preprocessing({}, {}, {}, None, [])
    filled = {f: F.coalesce(F.col(f).cast("double"), F.lit(m)) for f, m in medians.items()}
    moments = df.agg(*[e for f, x in filled.items() for e in (
        F.avg(x).alias(f"{f}__mean"), F.stddev_pop(x).alias(f"{f}__std"))]).first()
    means, scales = {}, {}
    for f in medians:
        mean, std = moments[f"{f}__mean"], moments[f"{f}__std"]
        means[f] = float(mean)
        scales[f] = 1.0 if std < 10 * 2.220446049250313e-16 * max(1.0, abs(mean)) else float(std)
    mode = product_mode(df).first()
    return Preprocessing(medians, means, scales, None if mode is None else mode["product"], list(medians))


# ------------------------------------------------------------------ M7-M10, M15
PRODUCT_TERM = "_product_term"
_FILLED = "_product_filled"


@dataclass
class FittedWinModel:
    """A logistic model: numeric coefficients as numbers, product coefficients as a table.

    ``levels`` has one row per product (product, product_index, coefficient) and
    is joined onto the rows to be scored, so a plan has the same size whatever
    the number of products; a dict stands for a table with a few rows.
    """

    prep: Preprocessing
    numeric: dict[str, float]
    intercept: float
    levels: DataFrame | dict[str, float]
    classes: ClassWeights | None = None

    def level_table(self, spark) -> DataFrame:
        if isinstance(self.levels, dict):
            rows = [(k, i, float(v)) for i, (k, v) in enumerate(sorted(self.levels.items()))]
            return spark.createDataFrame(rows, LEVELS)
        return self.levels

    def with_levels(self, df: DataFrame, **columns: str) -> DataFrame:
        """Attach columns of the level table (new name -> its column); NULL for a product it hasn't."""
        table = self.level_table(df.sparkSession).select(F.col("product").alias(_FILLED),
                                                         *[F.col(c).alias(n) for n, c in columns.items()])
        filled = df.withColumn(_FILLED, self.prep.product(F.col("product")))
        return lookup_join(filled, table, [_FILLED], written=True).drop(_FILLED)

    def prepare(self, df: DataFrame) -> DataFrame:
        """The table with its product terms, ready for ``probability`` and the margin grid."""
        return self.with_levels(df.drop(PRODUCT_TERM), **{PRODUCT_TERM: "coefficient"})

    def _terms(self, names: list[str], f: dict[str, Column], z: Column) -> Column:
        for name in names:
            z = z + F.lit(self.numeric[name]) * self.prep.z(name, f[name])
        return z

    def fixed_logit(self, f: dict[str, Column]) -> Column:
        """Intercept + product term + terms of margin-independent features (rows ``prepare`` has seen)."""
        z = F.lit(self.intercept) + F.coalesce(F.col(PRODUCT_TERM), F.lit(0.0))
        return self._terms([n for n in self.numeric if n not in MARGIN_VARYING], f, z)

    def varying_logit(self, f: dict[str, Column], fixed: Column) -> Column:
        return self._terms([n for n in self.numeric if n in MARGIN_VARYING], f, fixed)

    def grid_terms(self, f: dict[str, Column], fixed: Column) -> dict[str, Column]:
        """a, b, c, d of the logit a + b * margin + c * price + d / price; missing inputs take their medians."""
        zero = F.lit(0.0)
        slope = {n: self.numeric[n] / self.prep.scales[n] for n in self.numeric if n in MARGIN_VARYING}
        a, b, c, d = fixed, zero, zero, zero
        for n, k in slope.items():
            filled, mean = F.lit(k * (self.prep.medians[n] - self.prep.means[n])), F.lit(-k * self.prep.means[n])
            if n == "gross_margin_rate":
                a, b = a + mean, F.lit(k)
            elif n == "unit_price":
                a, c = a + mean, c + F.lit(k)
            elif n == "grant_ratio_to_subtotal":   # grant / (price * qty), the median where the subtotal is 0
                share = F.when(f["cost_per_unit"] != 0, F.try_divide(f["energy_grant_amount"], f["qty"]))
                a, d = a + F.when(share.isNotNull(), mean).otherwise(filled), F.coalesce(F.lit(k) * share, zero)
            else:
                price = f["avg_competitor_price" if n == "price_gap_avg_competitor_pct" else "min_competitor_price"]
                a = a + F.when(price.isNotNull(), F.lit(-100.0 * k) + mean).otherwise(filled)
                c = c + F.coalesce(F.lit(100.0 * k) / price, zero)
        return {"a": a, "b": b, "c": c, "d": d}

    def probability(self, f: dict[str, Column]) -> Column:
        """The model as a Column expression over rows ``prepare`` has seen (unknown product -> 0)."""
        return sigmoid(self.varying_logit(f, self.fixed_logit(f)))

    def product_index(self, df: DataFrame, out: str = "product_index") -> DataFrame:
        """M7: the place of the (mode-filled) product among the levels, NULL for a level the fit hasn't seen."""
        return self.with_levels(df, **{out: "product_index"})

    def coefficient_table(self, spark) -> DataFrame:
        rows = [("intercept", float(self.intercept))] + [(f"num:{k}", float(v)) for k, v in self.numeric.items()]
        return spark.createDataFrame(rows, "term string, coefficient double").unionByName(
            self.level_table(spark).select(F.concat(F.lit("product:"), "product").alias("term"), "coefficient"))

    # -------------------------------------------------------------- S3
    def numbers(self) -> str:
        """Everything but the level table, as one line of JSON."""
        return json.dumps({"prep": self.prep.__dict__, "numeric": self.numeric, "intercept": self.intercept,
                           "classes": None if self.classes is None else self.classes.to_lists()})

    def save(self, spark, path: str) -> int:
        """Write the model as the next version under ``path`` and return its number.

        The row of the version in the manifest comes last and holds checksums
        of the numbers and the level table: a version without one doesn't exist.
        """
        levels = self.level_table(spark)
        version = 1 + max([r["version"] for r in _manifest(spark, path)], default=0)
        folder = f"{path}/versions/{version}-{uuid.uuid4().hex}"
        levels.write.parquet(f"{folder}/levels")
        spark.createDataFrame([(self.numbers(),)], "numbers string").coalesce(1).write.parquet(f"{folder}/numbers")
        row = (version, folder.removeprefix(f"{path}/"), _checksum(self.numbers(), levels))
        spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
        return version

    @staticmethod
    def load(spark, path: str, version: int | None = None) -> FittedWinModel:
        """A version (default: the latest); raises ValueError if it is missing or not what was written."""
        known = {r["version"]: r for r in _manifest(spark, path)}
        row = known.get(max(known, default=None) if version is None else version)
        if row is None:
            raise ValueError(f"no model version {version or ''} under {path}")
        folder = f"{path}/{row['folder']}"
        numbers = spark.read.schema("numbers string").parquet(f"{folder}/numbers").first()["numbers"]
        levels = spark.read.schema(LEVELS).parquet(f"{folder}/levels")
        if _checksum(numbers, levels) != row["checksum"]:
            raise ValueError(f"model version {row['version']} under {path} is damaged")
        d = json.loads(numbers)
        return FittedWinModel(Preprocessing(**d["prep"]), d["numeric"], d["intercept"], levels,
                              None if d["classes"] is None else ClassWeights.from_lists(d["classes"]))


LEVELS = "product string, product_index int, coefficient double"
MANIFEST = "version int, folder string, checksum string"


def _manifest(spark, path: str) -> list:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()   # one row per version
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _checksum(numbers: str, levels: DataFrame) -> str:
    """Of the numbers and, whatever the order of its rows, the level table."""
    rows = levels.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*levels.columns).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{numbers}|{rows['n']}|{rows['s']}".encode()).hexdigest()


def _levels(fit: DataFrame) -> DataFrame:
    """(product, product_index, coefficient 0) of the products fitted on, numbered in their order."""
    products = fit.where(F.col("product").isNotNull()).groupBy("product").agg(F.lit(1).alias("one"))
    ranked = running_totals(products.withColumn("all", F.lit(1)), ["all"], ["product"], "one", "levels")
    return materialize(ranked.select("product", F.col("before").cast("int").alias("product_index"),
                                     F.lit(0.0).alias("coefficient"), F.lit(0.0).alias("step")), "levels")


BLOCKS = "block string, products array<string>, code binary, numbers binary"
BLOCK_ROWS = 4096   # lines of the fit in a row of its written table


def _packed(most: int):
    """Arrow function of lines (product, label, weight, scaled features): blocks of up to ``most`` lines, with the
    products in it, each line's place among them and the numbers, column after column."""
    def pack(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                b = batch.slice(start, most)
                y, w, *z = (c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[1:])
                w = np.where(np.isnan(y) | np.isnan(w), 0.0, w)   # a row without a label or a weight counts for nothing
                coded = b.column(0).dictionary_encode(null_encoding="encode")
                values = [uuid.uuid4().hex, coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int32).tobytes(),
                          np.stack([np.nan_to_num(y), w, *z]).tobytes()]
                types = [pa.string(), pa.list_(pa.string()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)],
                                                 names=["block", "products", "code", "numbers"])
    return pack


class _Newton:
    """Newton's method for C * sum(w * loss) + 0.5 * |beta|^2 (no penalty on the intercept).

    The Hessian is a small dense block (intercept and numeric terms), a
    *diagonal* block (one row has one product) and their coupling.  One
    aggregation per product gives all sums; eliminating the product block
    (Schur complement) leaves a system of 13 unknowns for the driver, and each
    product's step follows from that solution within the level table.
    """

    def __init__(self, fit: DataFrame, names: list[str], label: str, C: float, total: float):
        self.names, self.label, self.ridge, self.total = names, label, 1.0 / C, total
        self.size = len(names) + 1
        self.pairs = [(i, j) for i in range(self.size) for j in range(i, self.size)]
        wanted = fit.select("product", f"`{label}`", "_w", *[f"`z_{n}`" for n in names])
        # written once: a pass reads a few thousand lines as one row
        self.blocks = materialize(wanted.mapInArrow(_packed(BLOCK_ROWS), BLOCKS), "fit-blocks")

    def sums(self, u: np.ndarray, levels: DataFrame, count: int) -> DataFrame:
        """One pass: sums of loss, gradient and weight products, as ``dense`` rows over all products and as a row per product.

        A task adds up its rows in arrays (a matrix product per block) and writes one dense row and its products'
        rows: (coefficient, r0, s0_0, s0_1, ...), the sums that differ by product."""
        size, most = self.size, PRODUCTS_AT_ONCE
        upper = np.array(self.pairs).T
        few, blocks = None, self.blocks
        if count <= PRODUCTS_SENT:
            few = {r["product"]: r["coefficient"] for r in levels.select("product", "coefficient").collect()}
        else:   # the coefficients of a block's products go to it
            listed = blocks.select("block", F.posexplode("products").alias("i", "product"))
            known = null_safe_join(listed, levels.select("product", "coefficient"), ["product"]).groupBy("block").agg(
                F.sort_array(F.collect_list(F.struct("i", "coefficient")))["coefficient"].alias("known"))
            blocks = blocks.join(known, "block")

        def add_up(batches):
            dense, at, held, mine = np.zeros(1 + size + len(upper[0])), {}, np.zeros((0, size + 2)), 0

            def row(is_dense, products, values):
                flat = pa.array(values.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)
                return pa.RecordBatch.from_arrays([pa.array([is_dense] * len(values)), pa.array(products, pa.string()), lists],
                                                  names=["dense", "product", "sums"])

            for products, code, numbers, *known in (r for b in batches for r in zip(*b.columns)):
                products = products.as_py()
                code = np.frombuffer(code.as_buffer(), np.int32)
                y, w, *z = np.frombuffer(numbers.as_buffer()).reshape(size + 1, -1)
                known = np.array([few.get(k) for k in products] if few is not None else known[0].as_py(), float)
                mine += len(code)
                x = np.stack([np.ones(len(code)), *z])
                eta = np.nan_to_num(known)[code] + u @ x
                t = np.exp(-np.abs(eta))   # doesn't overflow
                p = np.where(eta < 0, t, 1.0) / (1 + t)
                r, s = w * (p - y), w * p * (1 - p)
                sx = x * s
                loss = w @ (np.maximum(eta, 0) + np.log1p(t) - y * eta)
                dense += np.concatenate([[loss], x @ r, (x @ sx.T)[upper[0], upper[1]]])
                part = np.stack([np.bincount(code, v, len(products)) for v in (r, *sx)], axis=1)
                place = np.array([at.setdefault(k, len(at)) for k in products])
                if len(at) > len(held):
                    held = np.concatenate([held, np.zeros((max(len(at), 2 * len(held)) - len(held), size + 2))])
                held[place, 0] = known
                held[place, 1:] += part
                if len(at) > most:
                    yield row(False, list(at), held[:len(at)])
                    at, held = {}, np.zeros((0, size + 2))
            if mine:
                yield row(True, [None], dense[None])
            if at:
                yield row(False, list(at), held[:len(at)])

        wanted = blocks.select("products", "code", "numbers", *([] if few is not None else ["known"]))
        return materialize(wanted.mapInArrow(add_up, "dense boolean, product string, sums array<double>"), "newton-sums")

    def totals(self, found: DataFrame):
        """(per product: coefficient, r0, s0_i; loss, dense gradient, dense Hessian, Schur terms, its right side, largest
        product gradient).  Every product's values go as one array, added place by place: a few hundred sums reach the driver."""
        added = [F.sum(F.col("sums")[i + 1]).alias(n) for i, n in enumerate(["r0", *[f"s0_{i}" for i in range(self.size)]])]
        per_level = materialize(found.where("NOT dense").groupBy("product").agg(
            F.nanvl(F.max(F.col("sums")[0]), F.lit(None).cast("double")).alias("coefficient"), *added), "newton-levels")
        diag = f"(s0_0 + {self.ridge!r}D)"
        grad = f"(r0 + {self.ridge!r}D * coefficient)"
        parts = {"loss": [f"0.5D * {self.ridge!r}D * coefficient * coefficient"], "steep": [grad],
                 "c": [f"s0_{i} * s0_{j} / {diag}" for i, j in self.pairs],
                 "e": [f"s0_{i} * {grad} / {diag}" for i in range(self.size)]}
        by_level = self._added(per_level.where("coefficient IS NOT NULL").select(
            F.expr(f"array({', '.join(v for part in parts.values() for v in part)})").alias("sums")), parts)
        loss, g, a = self._added(found.where("dense"), {"loss": [0], "g": range(self.size), "a": self.pairs})
        return (per_level, loss[0][0] + by_level[0][0][0], g[0], self._square(a[0]), self._square(by_level[2][0]), by_level[3][0],
                by_level[1][1][0])

    @staticmethod
    def _added(rows: DataFrame, parts: dict) -> list[tuple[np.ndarray, np.ndarray]]:
        """Arrays added place by place, cut into parts: (sums, largest magnitudes) of each."""
        sizes = [len(x) for x in parts.values()]
        both = np.zeros((2, sum(sizes)))
        for r in (rows.select(F.posexplode("sums").alias("at", "v")).groupBy("at")
                  .agg(F.sum("v").alias("total"), F.max(F.abs("v")).alias("most")).collect()):
            both[:, r["at"]] = r["total"], r["most"]
        return [tuple(x) for x in np.split(both, np.cumsum(sizes)[:-1], axis=1)]

    def _square(self, upper: list[float]) -> np.ndarray:
        out = np.zeros((self.size, self.size))
        for (i, j), v in zip(self.pairs, upper):
            out[i, j] = out[j, i] = v
        return out

    def solve(self, levels: DataFrame, max_iter: int, tol: float) -> tuple[np.ndarray, DataFrame]:
        ridge = np.diag([0.0] + [self.ridge] * (self.size - 1))
        u, du, share, best = np.zeros(self.size), np.zeros(self.size), 1.0, None
        count = levels.count()
        for _ in range(max_iter):
            per_level, loss, g, a, c, e, steepest = self.totals(self.sums(u, levels, count))
            loss += 0.5 * float(u @ ridge @ u)
            if best is not None and loss > best * (1 + 1e-12) and share > 1e-6:   # too far: go half of the way back
                share /= 2
                u = u - share * du
                levels = materialize(levels.withColumn("coefficient", F.col("coefficient") - F.lit(share) * F.col("step")), "levels")
                continue
            grad = g + ridge @ u
            if max(float(np.abs(grad).max()), steepest) <= tol * self.total:
                break
            best, share = loss, 1.0
            du = np.linalg.solve(a + ridge - c, e - grad)
            step = -(F.col("r0") + self.ridge * F.col("coefficient")
                     + sum((F.col(f"s0_{i}") * F.lit(float(v)) for i, v in enumerate(du)), F.lit(0.0))) / (F.col("s0_0") + self.ridge)
            moves = per_level.where(F.col("coefficient").isNotNull()).select("product", step.alias("step"))
            levels = materialize(levels.select("product", "product_index", "coefficient").join(moves, "product")
                                 .withColumn("coefficient", F.col("coefficient") + F.col("step")), "levels")
            u = u + du
        return u, levels


def fit_win_model(df: DataFrame, label: str = "is_win", C: float = LOGREG_C,
                  max_iter: int = LOGREG_MAX_ITER, features: list[str] = NUMERIC_FEATURES,
                  weighted_class_counts: bool = False, tol: float = 1e-10) -> FittedWinModel:
    """L2 logistic regression, C * sum(w * loss) + 0.5 * |beta|^2, solved by Newton's method.

    Sample weight = quote weight x balanced class weight.  ``tol`` bounds the
    gradient's largest term over the sum of weights.  A pass over the data per
    step, six or so of them, and nothing but sums per product leaves it.
    """
    prep = learn_preprocessing(df, features)
    weighted = quote_weights(select_features(df, ["quote_id", label, "product", *prep.features]))
    classes = class_weights(weighted.select(F.col(label).cast("int").alias(label), "quote_weight"), label, weighted_class_counts)
    # the columns of the fit only, scaled
    fit = weighted.select(F.col(label).cast("double").alias(label), prep.product(F.col("product")).alias("product"),
                          (F.col("quote_weight") * classes.column(F.col(label).cast("int"))).alias("_w"),
                          *[prep.z(f, F.col(f)).alias(f"z_{f}") for f in prep.features])
    levels = _levels(df.select(prep.product(F.col("product")).alias("product")))
    u, levels = _Newton(fit, prep.features, label, C, classes.total).solve(levels, max_iter, tol)
    return FittedWinModel(prep, dict(zip(prep.features, u[1:].tolist())), float(u[0]),
                          levels.select("product", "product_index", "coefficient"), classes)


def stationarity(model: FittedWinModel, df: DataFrame, label: str = "is_win", C: float = LOGREG_C) -> DataFrame:
    """|gradient of the objective| / sum of weights per term, at the fitted coefficients.

    0 at the optimum; one aggregation per product, so the plan doesn't grow with their number."""
    names = list(model.numeric)
    weighted = model.prepare(quote_weights(select_features(df, ["quote_id", label, "product", *names])))
    w = F.col("quote_weight") * model.classes.column(F.col(label))
    pull = w * (model.probability({f: F.col(f) for f in ["product", *names]}) - F.col(label))
    rows = weighted.withColumn("_pull", pull).withColumn(_FILLED, model.prep.product(F.col("product")))
    sums = rows.groupBy(_FILLED).agg(F.sum("_pull").alias("g"), *[
        F.sum(F.col("_pull") * model.prep.z(f, F.col(f))).alias(f"g_{f}") for f in names])
    dense = sums.agg(F.sum("g").alias("g"), *[F.sum(f"g_{f}").alias(f"g_{f}") for f in names])
    part = lambda term, g, b: F.struct(F.lit(term).alias("term"), (F.abs(g + F.lit(b / C)) / F.lit(model.classes.total)).alias("gradient"))
    terms = [part("intercept", F.col("g"), 0.0)] + [part(f"num:{f}", F.col(f"g_{f}"), b) for f, b in model.numeric.items()]
    levels = model.level_table(df.sparkSession).withColumnRenamed("product", _FILLED)
    products = levels.join(sums.select(_FILLED, "g"), _FILLED, "left").select(
        F.concat(F.lit("product:"), _FILLED).alias("term"),
        (F.abs(F.coalesce(F.col("g"), F.lit(0.0)) + F.col("coefficient") / C) / F.lit(model.classes.total)).alias("gradient"))
    return dense.select(F.explode(F.array(*terms)).alias("_r")).select("_r.*").unionByName(products)


# ------------------------------------------------------------------ M10
def predict_win(model: FittedWinModel, df: DataFrame, threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """Probability of a win (row-local after the lookup of the product terms) and the class at p >= threshold."""
    p = model.probability({f: F.col(f) for f in ["product", *model.prep.features]})
    return model.prepare(df).withColumn("win_probability", p).withColumn(
        "predicted_win", (F.col("win_probability") >= threshold).cast("int")).drop(PRODUCT_TERM)
