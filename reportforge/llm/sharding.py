"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes, in DataFrame functions.

Rows are shuffled where they lie. How many of them each partition sends to each cell (a shard, or a piece of one) is
drawn beforehand: a matrix whose rows sum to the partitions' sizes and whose columns sum to the cells', with the law that
a uniform permutation of all rows would give it. The exchange follows the matrix, and each cell shuffles what came.

Every random number is a hash of a seed and a place, so a task that runs again draws what it drew before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, free_name, staged, table

SHARDS = 16
#: Rows of a cell at which a shard is cut into more cells, and most cells of a shard.
CELL, CELLS = 1 << 16, 256
SEED = 13


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once a row, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fields(**values: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()])


def uniform(*keys: Column) -> Column:
    """A number of [0, 1) with 53 random bits that follow from the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") * F.lit(2.0**-53)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of `good` among `total` rows lie in `drawn` of them that are chosen at random: a draw by `u` of [0, 1).

    Inversion over the mode and its neighbours, up and down in turn, by ratios of neighbouring probabilities. It goes ten
    deviations and twenty more from the mode; what lies beyond has less than a double's last bit of the whole.
    """
    real = lambda x: x.cast("double")

    def inside(x: Column) -> Column:
        n, k, m = x["n"], x["k"], x["m"]
        mode = F.greatest(F.lit(0).cast("long"), m + k - n, F.least(m, k, F.floor((real(m) + 1) * (real(k) + 1) / (real(n) + 2))))
        spread = F.sqrt(real(m) * real(k) / n * (real(n) - k) / n * (real(n) - m) / F.greatest(n - 1, F.lit(1)))
        return let(fields(n=real(n), k=real(k), m=real(m), at=real(mode), far=F.least(m, k, F.ceil(10 * spread) + 20)), search)

    def search(x: Column) -> Column:
        n, k, m, at = x["n"], x["k"], x["m"], x["at"]
        steps = F.sequence(F.lit(1).cast("long"), F.greatest(x["far"], F.lit(1)))
        up = lambda w, i: w * (k - at - i + 1) * (m - at - i + 1) / ((at + i) * F.greatest(n - k - m + at + i, F.lit(1.0)))
        down = lambda w, i: w * F.greatest(at - i + 1, F.lit(0.0)) * F.greatest(n - k - m + at - i + 1, F.lit(0.0)) / ((k - at + i) * (m - at + i))
        one, none = F.lit(1.0), F.lit(0.0)
        summed = F.aggregate(steps, fields(a=one, b=one, s=one), lambda s, i: let(fields(a=up(s["a"], i), b=down(s["b"], i)), lambda y: fields(a=y["a"], b=y["b"], s=s["s"] + y["a"] + y["b"])), lambda s: s["s"])

        def found(goal: Column) -> Column:
            def move(s: Column, i: Column) -> Column:
                def place(y: Column) -> Column:
                    to = F.when(s["off"].isNotNull(), s["off"]).when(goal < s["s"] + y["a"], i).when(goal < s["s"] + y["a"] + y["b"], -i)
                    return fields(a=y["a"], b=y["b"], s=s["s"] + y["a"] + y["b"], off=to)

                return let(fields(a=up(s["a"], i), b=down(s["b"], i)), place)

            begin = fields(a=one, b=one, s=one, off=F.when(goal < one, F.lit(0).cast("long")))
            return F.aggregate(steps, begin, move, lambda s: (at + F.coalesce(s["off"], none)).cast("long"))

        return let(u * summed, found)

    return F.when((good <= 0) | (drawn <= 0), F.lit(0).cast("long")).when(drawn >= total, good).when(good >= total, drawn).otherwise(let(fields(n=total, k=good, m=drawn), inside))


def part_of(need: Column, drawn: Column, *keys: Column) -> Column:
    """array<long>: of `drawn` rows chosen at random among sum(need), how many fall to each place of `need`."""
    zero = F.lit(0).cast("long")
    begin = fields(left=F.aggregate(need, zero, lambda s, x: s + x), drawn=drawn, out=F.array().cast("array<long>"))

    def step(s: Column, x: Column) -> Column:
        draw = hypergeometric(s["left"], x, s["drawn"], uniform(*keys, F.size(s["out"])))
        return let(draw, lambda y: fields(left=s["left"] - x, drawn=s["drawn"] - y, out=F.concat(s["out"], F.array(y))))

    return F.aggregate(need, begin, step, lambda s: s["out"])


def communication_matrix(counts: DataFrame, need: Column, many: int, seed: int) -> DataFrame:
    """(pid, sends): for each of `many` partitions of `counts` (pid, n), the rows that it sends to each cell.

    Halves of the partitions are drawn first, then halves of those: every draw is a hypergeometric one given all before.
    One row with a number for each partition starts it; each round doubles the rows.
    """
    zero = F.lit(0).cast("long")
    nodes = counts.agg(F.array_sort(F.collect_list(F.struct("pid", "n"))).alias("of")).filter(F.size("of") > 0).select("of", need.alias("need"))
    while many > 1:
        many = -(-many // 2)
        half = F.ceil(F.size("of") / 2).cast("int")
        left = F.slice("of", F.lit(1), half)
        got = part_of(F.col("need"), F.aggregate(left, zero, lambda s, x: s + x["n"]), F.lit(seed), F.get("of", F.lit(0))["pid"], F.size("of"))
        split = let(got, lambda g: F.array(fields(of=left, need=g), fields(of=F.slice("of", half + 1, F.size("of")), need=F.zip_with("need", g, lambda x, y: x - y))))
        nodes = nodes.select(F.explode(F.when(F.size("of") > 1, split).otherwise(F.array(fields(of=F.col("of"), need=F.col("need"))))).alias("node")).select("node.*")
    return nodes.select(F.get("of", F.lit(0))["pid"].alias("pid"), F.col("need").alias("sends"))


def cell_sizes(rows: int, shards: int, cells: int) -> Column:
    """array<long>: the exact sizes of all cells, those of shard 0 first: neither shards nor a shard's cells differ by more than one."""
    own = lambda n, of, k: F.floor(n / of) + (k < n % of).cast("long")
    shard = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: own(F.lit(rows), F.lit(shards), j))
    return F.flatten(F.transform(shard, lambda m: F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda k: own(m, F.lit(cells), k))))


def shuffled(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, cell: int = CELL) -> DataFrame:
    """`rows` with shard (int, from 0) and slot (long, gapless from 0 in each shard): all rows in uniformly random order.

    Shard sizes differ by one at most. Each row is dealt by itself, whatever it holds: equal rows and equal texts fall
    where chance puts them. The order depends on `seed` and on how the rows lie in partitions. Null values count like
    others. An empty table gives no rows; with fewer rows than shards some shards stay empty. Columns of `rows` named
    shard or slot are replaced.
    """
    rows = rows.drop(*[c for c in rows.columns if c.lower() in ("shard", "slot")])
    came, mid, pid, nth, cellno, sends = (free_name(rows, x) for x in ("came", "mid", "pid", "nth", "cell", "sends"))
    own = rows.withColumn(came, F.xxhash64(F.lit(seed), F.monotonically_increasing_id())).sortWithinPartitions(came)
    # A row's place in its partition is written beside it, so every later read agrees.
    laid = staged(own.drop(came).withColumn(mid, F.monotonically_increasing_id()), "laid", "zstd")
    laid = laid.withColumns({pid: F.shiftright(mid, 33), nth: F.col(mid).bitwiseAND((1 << 33) - 1)})
    counts = staged(laid.groupBy(F.col(pid).alias("pid")).agg(F.count("*").alias("n")), "counts", "zstd")
    many, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    cells = max(1, min(CELLS, -(-total // (shards * cell))))
    matrix = communication_matrix(counts, cell_sizes(total, shards, cells), many, seed)
    # Where each cell's rows end in the partition's own order; partitions * cells numbers, which Spark broadcasts only below its limit.
    matrix = staged(matrix.select(F.col("pid").alias(pid), ends(F.col("sends")).alias(sends)), "matrix", "zstd")
    sent = laid.join(matrix, pid).withColumn(cellno, first_above(F.col(sends), F.col(nth), shards * cells)).drop(sends)
    again = F.row_number().over(W.partitionBy(cellno).orderBy(F.xxhash64(F.lit(seed + 1), mid), mid)) - 1
    shard, k = F.floor(F.col(cellno) / cells), F.col(cellno) % cells
    size = F.lit(total // shards) + (shard < total % shards).cast("long")
    base = k * F.floor(size / cells) + F.least(k, size % cells)
    discard(counts)
    return sent.withColumns({"shard": shard.cast("int"), "slot": (base + again).cast("long")}).drop(mid, pid, nth, cellno)


def ends(sends: Column) -> Column:
    """Running sums of an array, each with its own place."""
    begin = fields(s=F.lit(0).cast("long"), out=F.array().cast("array<long>"))
    return F.aggregate(sends, begin, lambda s, x: fields(s=s["s"] + x, out=F.concat(s["out"], F.array(s["s"] + x))), lambda s: s["out"])


def first_above(sums: Column, at: Column, n: int) -> Column:
    """The first place (from 0) of `n` rising sums that is above `at`, by halving."""
    bits = F.array(*[F.lit(1 << b) for b in range(max(1, (n - 1).bit_length()))[::-1]])
    return F.aggregate(bits, F.lit(0), lambda lo, b: F.when(lo + b <= n - 1, F.when(F.get(sums, lo + b - 1) <= at, lo + b).otherwise(lo)).otherwise(lo))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 by the law `rows`: a uniform shuffle takes no notice of groups of equal texts."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffled(docs, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
