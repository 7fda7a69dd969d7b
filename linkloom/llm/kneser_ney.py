"""A quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

Training counts n-grams of all trusted documents of each language, by map-side combined sums. Lower orders count the
distinct n-grams that extend them to the left; discounts for counts of one, two, and three or more follow, for each
language and order, from the counts of counts.

Scoring asks, for each group of GROUP bytes of an input file, which distinct n-grams it has (a set that the texts' bytes
bound, map-side combined), and joins the distinct requests, order by order, to sharded tables of counts. Probabilities go back to the groups that
asked, where they meet the texts, compressed, in a stream. So no table of the model is broadcast or held whole.

A document is kept if its mean log probability per byte lies within quantiles of its language: those of trusted documents
that training left out, widened by their spread. As the mean of a short text says little, PRIOR bytes at the language's
median count with it.

Cases: null and empty texts have no perplexity and are not kept; a null language is one of its own; languages without
trusted text have no model, and their documents no perplexity, and are kept; repeated rows are scored alike; labels of
unknown documents are ignored, and a document that any label calls trusted is; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import checkpointed, held_out, pack, ship, swept, unpack

ORDER = 4
#: Quantiles of a language's trusted documents, and the interquartile ranges that they are widened by.
LOW, HIGH = 0.005, 0.995
WIDEN_LOW, WIDEN_HIGH = 1.0, 3.0  # a text that is too predictable is less suspect than one that is too odd
PRIOR = 200.0
#: The least spread that counts, and how many trusted documents more must be left out for the quantiles to be trusted:
#: the ranges are widened by FEW / their number besides.
LEAST_SPREAD, FEW = 0.03, 20.0
#: Bytes of text in a group that is scored together, where what a task reads of a stretch of an input file has more, and bytes
#: of a stretch.
GROUP, STRETCH = 128_000_000, 64_000_000


def _grams(text: bytes, order: int):
    """The n-gram that ends at each byte, as a number; zero bytes stand before the text."""
    import numpy as np

    b = np.frombuffer(b"\0" * (order - 1) + text, np.uint8).astype(np.int64)
    out = b[: len(b) - order + 1].copy()
    for k in range(1, order):
        out = out << 8 | b[k : len(b) - order + 1 + k]
    return out


#: n-grams that wait for being counted, and counted ones that a task holds, before it passes them on.
WAITING, HELD = 500_000, 2_000_000


def _grams_in_parts(text: bytes, order: int):
    """_grams, for texts of any length."""
    for at in range(0, len(text), WAITING):
        found = _grams(text[max(0, at - order + 1) : at + WAITING], order)
        yield found[order - 1 :] if at else found  # without those of the bytes that came before


def _count(order: int, packed: bool):
    """(*names, text) -> (*names, gram, n): n-grams of a task's rows, combined over rows with equal names."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        waiting: dict[tuple, list] = {}
        held: dict[tuple, tuple] = {}
        n_waiting, schema = 0, None

        def count():
            for key, parts in waiting.items():
                values, counts = np.unique(np.concatenate(parts), return_counts=True)
                if key in held:
                    values, back = np.unique(np.concatenate((held[key][0], values)), return_inverse=True)
                    counts = np.bincount(back, np.concatenate((held[key][1], counts))).astype(np.int64)
                held[key] = values, counts
            waiting.clear()

        def ready():
            for key, (values, counts) in held.items():
                columns = [pa.array([k] * len(values), f.type) for k, f in zip(key, schema)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(values), pa.array(counts)], names=[*schema.names[:-1], "gram", "n"])
            held.clear()

        for batch in batches:
            schema = batch.schema
            names = [c.to_pylist() for c in batch.columns[:-1]]
            for k, text in enumerate(batch.columns[-1]):
                text = unpack(text.as_py()) if packed else (text.as_py() or "").encode()
                for found in _grams_in_parts(text, order):
                    waiting.setdefault(tuple(n[k] for n in names), []).append(found)
                    n_waiting += len(found)
                    if n_waiting >= WAITING:
                        count()
                        n_waiting = 0
                        if sum(len(v) for v, _ in held.values()) >= HELD:
                            yield from ready()
        count()
        yield from ready()

    return run


def _as(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def _last(gram: Column, n: Column | int) -> Column:
    """The last n bytes of an n-gram."""
    n = F.lit(n) if isinstance(n, int) else n
    return gram.bitwiseAND(F.pow(F.lit(256), n).cast("long") - 1)


def train(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame, int]:
    """(lang, gram, n) of the highest order -> (lang, level, gram, alpha), (lang, level, context, gamma), order.

    alpha: an n-gram's discounted share of its context's counts; gamma: what the discounts leave to the level below.
    """
    level = checkpointed(counts.select("lang", "gram", "n"))
    swept(level.sparkSession)  # the texts that moved
    types = level.select("lang", F.lit(order).alias("level"), "gram", "n")
    for n in range(order - 1, 0, -1):
        level = level.groupBy("lang", _last(F.col("gram"), n).alias("gram")).agg(F.count("*").alias("n"))
        types = types.unionAll(level.select("lang", F.lit(n), "gram", "n"))
    types = checkpointed(types)
    seen = types.groupBy("lang", "level").agg(*[F.sum(F.when(F.col("n") == c, 1).otherwise(0)).alias(f"n{c}") for c in (1, 2, 3, 4)])
    y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0))
    # Where counts of counts leave a discount undefined, half of the least count it is taken from.
    d = lambda c: F.least(F.greatest(F.coalesce(c - F.lit(float(c + 1)) * y * F.col(f"n{c + 1}") / F.nullif(F.col(f"n{c}"), F.lit(0)), F.lit(c / 2)), F.lit(0.05)), F.lit(c - 0.05))
    discounts = seen.select(F.col("lang").alias("l"), F.col("level").alias("v"), F.array(d(1), d(2), d(3)).alias("d"))
    cut = types.join(discounts, types["lang"].eqNullSafe(discounts["l"]) & (types["level"] == discounts["v"])).drop("l", "v")
    cut = cut.select("lang", "level", "gram", "n", F.element_at("d", F.least(F.col("n"), F.lit(3)).cast("int")).alias("cut"), F.shiftright("gram", 8).alias("context"))
    whole = checkpointed(cut.groupBy("lang", "level", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed")))
    of = _as(whole, l="lang", v="level", c="context", total="total")
    alpha = cut.join(of, cut["lang"].eqNullSafe(of["l"]) & (cut["level"] == of["v"]) & (cut["context"] == of["c"]))
    alpha = alpha.select("lang", "level", "gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("alpha"))
    return alpha, whole.select("lang", "level", "context", (F.col("freed") / F.col("total")).alias("gamma")), order


def probabilities(requests: DataFrame, model: tuple[DataFrame, DataFrame, int]) -> DataFrame:
    """(lang, gram) -> (lang, gram, p): each distinct request meets the counts of all its levels in one join, and those of
    their contexts in another."""
    alpha, gamma, order = model
    rows = requests.select("lang", "gram").distinct().select("lang", "gram", F.explode(F.sequence(F.lit(1), F.lit(order))).alias("level"))
    rows = rows.withColumn("end", _last(F.col("gram"), F.col("level")))
    a, g = _as(alpha, al="lang", av="level", ag="gram", alpha="alpha"), _as(gamma, gl="lang", gv="level", gc="context", gamma="gamma")
    rows = rows.join(a, rows["lang"].eqNullSafe(a["al"]) & (rows["level"] == a["av"]) & (rows["end"] == a["ag"]), "left").drop("al", "av", "ag")
    rows = rows.join(g, rows["lang"].eqNullSafe(g["gl"]) & (rows["level"] == g["gv"]) & (F.shiftright(rows["end"], 8) == g["gc"]), "left").drop("gl", "gv", "gc")
    at = lambda c, n, other: F.coalesce(F.max(F.when(F.col("level") == n, F.col(c))), F.lit(other))
    found = rows.groupBy("lang", "gram").agg(*[at("alpha", n, 0.0).alias(f"a{n}") for n in range(1, order + 1)], *[at("gamma", n, 1.0).alias(f"g{n}") for n in range(1, order + 1)])
    p = F.lit(1.0 / 256)
    for n in range(1, order + 1):
        p = F.col(f"a{n}") + F.col(f"g{n}") * p
    return found.select("lang", "gram", p.alias("p"))


def _score(order: int):
    """Over rows sorted by part and kind (0: lang, gram, log_p; 1: id, lang, packed): (id, lang, n_bytes, log_p)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        part, held, tables = None, {}, None
        schema = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("n_bytes", pa.int64()), ("log_p", pa.float64())])
        for batch in batches:
            parts, kinds = (batch.column(c).to_numpy() for c in (0, 1))
            cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
            out: list[tuple] = []
            for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [batch.num_rows]))):
                if a == b:
                    continue
                if parts[a] != part:
                    part, held, tables = parts[a], {}, None
                some = batch.slice(a, b - a)
                if kinds[a] == 0:
                    langs = some.column(3).dictionary_encode()
                    codes = langs.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                    for code in np.unique(codes):
                        lang = None if code < 0 else langs.dictionary[int(code)].as_py()
                        held.setdefault(lang, []).append((some.column(5).to_numpy()[codes == code], some.column(6).to_numpy()[codes == code]))
                    continue
                if tables is None:
                    tables = {}
                    for lang, many in held.items():
                        grams, logs = (np.concatenate([m[i] for m in many]) for i in (0, 1))
                        place = np.argsort(grams)
                        tables[lang] = grams[place], logs[place]
                for key, lang, packed in zip(some.column(2).to_pylist(), some.column(3).to_pylist(), some.column(4)):
                    text = unpack(packed.as_py())
                    log_p = None
                    if text and lang in tables:
                        grams, logs = tables[lang]
                        log_p = 0.0
                        for own in _grams_in_parts(text, order):
                            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
                            if not (grams[at] == own).all():
                                raise ValueError("an n-gram of a text was not asked for")
                            log_p += float(logs[at].sum())
                        log_p /= len(text)
                    out.append((key, lang, len(text), log_p))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _grouped(inner, most: int):
    """inner over (part, ...), for rows (place, other, ..., text): a place is a stretch of an input file, and the rows that a task
    reads of it are dealt to parts by the bytes before them; rows without a place keep `other`.

    A file's rows come in the same order whenever it is read, so that both readings deal alike; if they ever do not,
    _score finds n-grams that were not asked for, and fails.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def parts():
            before: dict[int, int] = {}
            for batch in batches:
                sizes = pc.fill_null(pc.binary_length(batch.columns[-1]), 0)
                out = []
                for place, other, n in zip(*(c.to_pylist() for c in (*batch.columns[:2], sizes))):
                    if place is not None:
                        at = before.get(place, 0)
                        before[place] = at + n
                        other = (place + at // most * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63)
                    out.append(other)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), *batch.columns[2:]], names=["part", *batch.schema.names[2:]])

        yield from inner(parts())

    return run


def score(df: DataFrame, model: tuple[DataFrame, DataFrame, int], langs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> DataFrame:
    """(id, lang, n_bytes, log_p): mean log probability per byte, null without text or model."""
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length(f"`{text_col}`"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * size / GROUP))
    # Rows that come from no file have no order of their own, and go by a digest.
    place = F.when(F.input_file_name() != "", F.xxhash64(F.input_file_name(), F.floor(F.input_file_block_start() / STRETCH)))
    other = F.pmod(F.xxhash64(f"`{id_col}`", f"`{text_col}`"), F.lit(max(1, math.ceil(size / GROUP))))
    rows = df.select(place.alias("place"), other.alias("other"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    asked = rows.select("place", "other", "lang", "text").mapInArrow(_grouped(_count(order, False), GROUP), "part long, lang string, gram long, n long").groupBy("part", "lang", "gram").agg(F.lit(1).alias("one"))
    asked = checkpointed(asked.join(langs.select(F.col("lang").alias("l")), F.col("lang").eqNullSafe(F.col("l")), "left_semi").select("part", "lang", "gram"))
    swept(spark)
    p = probabilities(asked, model)
    p = _as(p, l="lang", g="gram", p="p")
    told = asked.join(p, asked["lang"].eqNullSafe(p["l"]) & (asked["gram"] == p["g"]))
    none = lambda kind: F.lit(None).cast(kind)
    told = told.select("part", F.lit(0).alias("kind"), none("long").alias("id"), "lang", none("binary").alias("packed"), "gram", F.log("p").alias("log_p"))
    texts = rows.select("place", "other", "id", "lang", "text").mapInArrow(_grouped(pack, GROUP), "part long, id long, lang string, packed binary")
    texts = texts.select("part", F.lit(1), "id", "lang", "packed", none("long"), none("double"))
    met = told.unionAll(texts).repartition(partitions, "part").sortWithinPartitions("part", "kind")
    return met.mapInArrow(_score(order), "id long, lang string, n_bytes long, log_p double")


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", trusted: Column | None = None, order: int = ORDER) -> DataFrame:
    """(id, lang, n_bytes, perplexity, low, high, kept) of every document."""
    ship(df.sparkSession)
    trusted = F.col("quality") == 1 if trusted is None else trusted
    good = labels.where(trusted).select(F.col(id_col).alias("good")).distinct()
    # Left out on both sides of the join, so that their texts do not move.
    packed = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where(~held_out(F.col("id"))).mapInArrow(pack, "id long, lang string, packed binary")
    fit = packed.join(good.where(~held_out(F.col("good"))), F.col("id") == F.col("good"), "left_semi").select("lang", "packed")
    counts = fit.mapInArrow(_count(order, True), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model = train(counts, order)
    langs = checkpointed(model[1].where("level = 1").select("lang").distinct())
    scored = checkpointed(score(df, model, langs, id_col, text_col, lang_col, order))
    left_out = scored.where(held_out(F.col("id")) & F.col("log_p").isNotNull()).join(good, F.col("id") == F.col("good"), "left_semi")
    middle = left_out.groupBy("lang").agg(F.percentile_approx("log_p", 0.5, 1000).alias("middle"))
    middle = checkpointed(middle.select(F.col("lang").alias("m"), "middle"))

    def steadied(rows: DataFrame) -> DataFrame:
        rows = rows.join(middle, rows["lang"].eqNullSafe(middle["m"]), "left").drop("m")
        return rows.withColumn("steady", (F.col("log_p") * F.col("n_bytes") + PRIOR * F.coalesce("middle", "log_p")) / (F.col("n_bytes") + PRIOR))

    q = steadied(left_out).groupBy("lang").agg(F.percentile_approx("steady", [LOW, 0.25, 0.75, HIGH], 1000).alias("q"), F.count("*").alias("n"))
    spread = F.greatest(F.col("q")[2] - F.col("q")[1], F.lit(LEAST_SPREAD))
    wide = lambda by: (by + FEW / F.col("n")) * spread
    limits = q.select(F.col("lang").alias("l"), (F.col("q")[0] - wide(WIDEN_LOW)).alias("low"), (F.col("q")[3] + wide(WIDEN_HIGH)).alias("high"))
    out = steadied(scored)
    out = out.join(limits, out["lang"].eqNullSafe(limits["l"]), "left").drop("l")
    kept = (F.col("n_bytes") > 0) & F.coalesce(F.col("steady").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select(F.col("id").alias(id_col), "lang", "n_bytes", F.exp(-F.col("log_p")).alias("perplexity"), F.exp(-F.col("high")).alias("least_perplexity"), F.exp(-F.col("low")).alias("most_perplexity"), kept.alias("kept"))


def op7(df: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(df, labels, trusted=(F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
