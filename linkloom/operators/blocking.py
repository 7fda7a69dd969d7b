"""Blockers: candidate pairs (s1_id, cand_id), each pair once.

Every layer is one equi-join on all of its keys, so that no wide intermediate appears; hot keys are bounded by the
caps on frequency and postings, and what is left of skew is split at run time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import normalize as N
from linkloom.operators.features import with_records
from linkloom.operators.postings import BlockConfig, capped, document_frequency, exploded, posting_sizes, prepared, rarest, smallest_posting
from linkloom.sources.shared import kept


def _split(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    return records.where("src = 1"), records.where("src <> 1")


def _pairs(s1: DataFrame, ref: DataFrame, keys: list[str]) -> DataFrame:
    left = s1.select(F.col("entity_id").alias("s1_id"), *keys)
    right = ref.select(F.col("entity_id").alias("cand_id"), *keys)
    return left.join(right, keys).select("s1_id", "cand_id")


#: Rows of either side in a block of pairs, and pairs that a task makes, about.
SIDE, TASK = 512, 500_000


def _sides(s1: DataFrame, ref: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Rows (entity_id, key, r) of both sides in blocks (key, i, j) whose rows make pairs, as s1_id, a and cand_id, b; the
    number of blocks of large keys on each side; and how many tasks there are pairs for."""
    sides = [x.groupBy(key).agg(F.count("*").alias(n)) for x, n in ((s1, "l"), (ref, "r"))]
    sizes = kept(sides[0].join(sides[1], key))
    total = sizes.agg(F.sum(F.col("l") * F.col("r"))).first()[0] or 0
    tasks = max(s1.sparkSession.sparkContext.defaultParallelism, -(-total // TASK))
    blocks = lambda c: F.ceil(F.col(c) / SIDE)
    large = F.broadcast(sizes.where((F.col("l") > SIDE) | (F.col("r") > SIDE)).select(key, blocks("l").alias("l"), blocks("r").alias("r")))

    def side(rows: DataFrame, named: str, carried: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        rows = rows.select(F.col("entity_id").alias(named), F.col("r").alias(carried), key).join(large, key, "left")
        rows = rows.withColumn(own, _block(named, own_n))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other_n, F.lit(1).cast("long")) - 1)))
        return rows.drop("l", "r")

    return side(s1, "s1_id", "a", "i", "l", "j", "r"), side(ref, "cand_id", "b", "j", "r", "i", "l"), large, tasks


def _block(named: str, n: str) -> Column:
    return F.pmod(F.xxhash64(named), F.coalesce(n, F.lit(1).cast("long")))


def _dealt(s1: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """Pairs of rows (entity_id, key, r) of equal keys as (s1_id, cand_id, a, b). The rows are few against the pairs that they
    make: a large key's pairs are dealt out in blocks, and as many tasks make them as there are pairs for."""
    left, right, _, tasks = _sides(s1, ref, key)
    left, right = (x.repartition(tasks, key, "i", "j") for x in (left, right))
    return left.join(right, [key, "i", "j"]).select("s1_id", "cand_id", "a", "b")


def named_alike(rows: DataFrame, without: DataFrame | None = None, carry: tuple = ("addr", "ctry", "number")) -> DataFrame:
    """The pairs of prepared records with equal names but those of `without`, not yet made: rows (name, i, j, side, id, other and
    what they carry), those of a block (name, i, j) one after the other in one task. Its pairs are those of side 0 (S1) with
    side 1, without the pairs id, other of side 2."""
    keyed = rows.where("name <> ''").withColumn("r", F.struct(*carry))
    s1, ref = _split(keyed)
    left, right, large, tasks = _sides(s1, ref, "name")
    names = lambda x, named: x.select(F.col("entity_id").alias(named), "name")
    out = [x.select("name", "i", "j", F.lit(k).alias("side"), F.col(named).alias("id"), F.lit("").alias("other"), f"{r}.*") for k, (x, named, r) in enumerate(((left, "s1_id", "a"), (right, "cand_id", "b")))]
    if without is not None:
        gone = without.join(names(s1, "s1_id"), "s1_id").join(names(ref, "cand_id"), ["cand_id", "name"]).join(large, "name", "left")
        out.append(gone.select("name", _block("s1_id", "l").alias("i"), _block("cand_id", "r").alias("j"), F.lit(2).alias("side"), F.col("s1_id").alias("id"), F.col("cand_id").alias("other"), *[F.lit("").alias(c) for c in carry]))
    return reduce(DataFrame.unionByName, out).repartition(tasks, "name", "i", "j").sortWithinPartitions("name", "i", "j", "side")


def named_apart(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Of edges those that named_alike doesn't make: of different names, or empty ones."""
    names = lambda named, name: rows.select(F.col("entity_id").alias(named), F.col("name").alias(name))
    both = edges.join(names("s1_id", "own"), "s1_id").join(names("cand_id", "other"), "cand_id")
    return both.where("own <> other or own = ''").select("s1_id", "cand_id")


def union(*edges: DataFrame) -> DataFrame:
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.distinct()


def checked_union(spine: DataFrame, *edges: DataFrame) -> DataFrame:
    """union; the query that uses it fails if a pair's S1 entity is not in the spine."""
    known = spine.select("s1_id", F.lit(True).alias("known")).distinct()
    rows = union(*edges).join(known, "s1_id", "left")
    return rows.where(F.coalesce("known", F.raise_error(F.concat(F.lit("unknown S1 entity: "), F.col("s1_id"))).cast("boolean"))).select("s1_id", "cand_id")


def exact(records: DataFrame, key: Column, guarded: bool = True) -> DataFrame:
    """Equal keys; empty ones match each other unless guarded."""
    rows = records.withColumn("key", key)
    s1, ref = _split(rows.where("key <> ''") if guarded else rows)
    return _pairs(s1, ref, ["key"])


def exact_name(records: DataFrame) -> DataFrame:
    return exact(records, N.ascii_text(F.col("business_name")))


def exact_basic_name(records: DataFrame) -> DataFrame:
    return exact(records, N.basic(F.col("business_name")), guarded=False)


def rare_tokens(records: DataFrame, config: BlockConfig, with_country: bool) -> DataFrame:
    """Any of the S1 entity's k rarest basic name tokens, in the raw country if asked for."""
    tok = exploded(records, N.basic_tokens(F.col("business_name"), config.min_len), "country")
    s1, ref = _split(tok)
    anchors = rarest(s1, document_frequency(ref), config.top_k, config.max_df)
    return _pairs(anchors, ref, ["country", "token"] if with_country else ["token"]).distinct()


def _name_tokens(rows: DataFrame, config: BlockConfig, country: str = "ctry") -> tuple[DataFrame, DataFrame]:
    """Name tokens of S1, as configured, and of the others, each once."""
    s1, ref = _split(rows)
    return exploded(s1, N.tokens(F.col("name"), config.min_len, not config.repeat_tokens), country), exploded(ref, N.tokens(F.col("name"), config.min_len), country)


def _apart(left: DataFrame, right: DataFrame, keys: list[str], rows: DataFrame | None) -> DataFrame:
    """Pairs of equal keys; if rows (entity_id, name) are given, those of different names alone."""
    if rows is None:
        return _pairs(left, right, keys).distinct()
    name = rows.select("entity_id", "name")
    left = left.join(name, "entity_id").select(F.col("entity_id").alias("s1_id"), F.col("name").alias("own"), *keys)
    right = right.join(name, "entity_id").select(F.col("entity_id").alias("cand_id"), F.col("name").alias("other"), *keys)
    return left.join(right, keys).where("own <> other").select("s1_id", "cand_id").distinct()


def _number_layer(rows: DataFrame, anchors: DataFrame, names: DataFrame, country: str, apart: bool = False) -> DataFrame:
    """Country, name token and house number in one join."""
    numbered = rows.where("number <> ''").select("entity_id", "number")
    return _apart(anchors.join(numbered, "entity_id"), names.join(numbered, "entity_id"), ["country", "token", "number"], rows if apart else None)


def _address_layer(best: DataFrame, anchors: DataFrame, names: DataFrame, addresses: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Country, name token and the S1 entity's address token in one join."""
    left = anchors.join(best.select("entity_id", F.col("token").alias("addr_token")), "entity_id")
    right = names.join(addresses.select("entity_id", F.col("token").alias("addr_token")), "entity_id")
    return _apart(left, right, ["country", "token", "addr_token"], rows)


#: Columns of prepared records that layers use.
PREPARED = ("entity_id", "src", "name", "addr", "ctry", "number")


def repeated(records: DataFrame) -> bool:
    """Whether records share an identifier."""
    return not records.groupBy("entity_id").count().where("count > 1").isEmpty()


def _layers(records: DataFrame, config: BlockConfig) -> tuple[DataFrame, Callable[[bool], list[DataFrame]]]:
    """Prepared rows, and what makes the layers of rare tokens, of pairs of different names alone if asked for."""
    rows = kept(prepared(records).select(*PREPARED))
    s1_names, ref_names = _name_tokens(rows, config)
    df = document_frequency(ref_names)
    anchors = rarest(s1_names, df, config.top_k, config.max_df).select("entity_id", "country", "token").distinct()
    names = ref_names.join(df.where(F.col("df") <= config.max_df).select("token"), "token", "left_semi")
    s1, ref = _split(rows)
    addresses = capped(exploded(ref, N.tokens(F.col("addr"), config.min_len)), config.posting_cap)
    best = smallest_posting(exploded(s1, N.tokens(F.col("addr"), config.min_len), place=True), posting_sizes(addresses), config.ties_by_place)
    return rows, lambda apart: [_number_layer(rows, anchors, names, "ctry", apart), _address_layer(best, anchors, names, addresses, rows if apart else None)]


def v1_parts(records: DataFrame, **changes) -> tuple[DataFrame, DataFrame]:
    """Of records that share no identifier: the prepared rows, whose pairs of equal names V1 has, and its other pairs."""
    rows, layers = _layers(records, BlockConfig(**{"top_k": 1} | changes))
    return rows, union(*layers(True))


def layered(records: DataFrame, config: BlockConfig, carry: DataFrame | None = None) -> DataFrame:
    """Exact name; rare name tokens with the house number; rare name tokens with the rarest address token.

    carry: (entity_id, ...), a row for each record; pairs then come with both of its rows, as structs a and b, and without
    a join of pairs for those of equal names, which are nearly all. The other layers look for pairs of different names, so
    that no pair is made twice, unless records share an identifier.
    """
    rows, layers = _layers(records, config)
    if repeated(rows):
        edges = union(exact(rows, F.col("name")), *layers(False))
        return edges if carry is None else with_records(edges, carry)
    rest = union(*layers(True))
    keyed = rows.where("name <> ''").select("entity_id", "src", "name")
    if carry is None:
        s1, ref = _split(keyed.withColumn("r", F.lit(0)))
        return _dealt(s1, ref, "name").select("s1_id", "cand_id").unionAll(rest)
    s1, ref = _split(keyed.join(carry.select("entity_id", F.struct(*[c for c in carry.columns if c != "entity_id"]).alias("r")), "entity_id"))
    return _dealt(s1, ref, "name").unionAll(with_records(rest, carry))


def v1(records: DataFrame, carry: DataFrame | None = None, **changes) -> DataFrame:
    return layered(records, BlockConfig(**{"top_k": 1} | changes), carry)


def v2(records: DataFrame, **changes) -> DataFrame:
    """Two anchors, which a repeated token may take up both; ties between address tokens go to the first."""
    return layered(records, BlockConfig(**{"top_k": 2, "repeat_tokens": True, "ties_by_place": True} | changes))


def v3(records: DataFrame, **changes) -> DataFrame:
    return layered(records, BlockConfig(**{"top_k": 3} | changes))


def bounded(records: DataFrame, **changes) -> DataFrame:
    """Unions of capped postings without intersection."""
    config = BlockConfig(**{"top_k": 2} | changes)
    rows = kept(prepared(records).select(*PREPARED))
    s1_names, ref_names = _name_tokens(rows, config)
    df = document_frequency(ref_names)
    anchors = rarest(s1_names, df, config.top_k, config.max_df)
    names = capped(ref_names.join(df.where(F.col("df") <= config.max_df).select("token"), "token", "left_semi"), config.name_cap)
    s1, ref = _split(rows)
    numbers = capped(exploded(ref, F.filter(F.array("number"), lambda x: x != "")), config.number_cap)
    addresses = capped(exploded(ref, N.tokens(F.col("addr"), config.min_len)), config.address_cap)
    return union(
        exact(rows, F.col("name")),
        _pairs(anchors, names, ["country", "token"]),
        _pairs(exploded(s1, F.filter(F.array("number"), lambda x: x != "")), numbers, ["country", "token"]),
        _pairs(exploded(s1, N.tokens(F.col("addr"), config.min_len)), addresses, ["country", "token"]),
    )


def pilot_variants(records: DataFrame, max_posting: int = 50_000, min_len: int = 4) -> dict[str, DataFrame]:
    """Five variants; the name anchor is the smallest posting within the raw country, not the globally rarest token."""
    rows = kept(prepared(records).select(*PREPARED, "country"))
    s1, ref = _split(rows)
    toks = lambda part, column: exploded(part, N.tokens(F.col(column), min_len), "country")
    names, addresses = toks(ref, "name"), toks(ref, "addr")
    anchors = smallest_posting(toks(s1, "name"), posting_sizes(names), max_size=max_posting)
    best = smallest_posting(toks(s1, "addr"), posting_sizes(addresses), max_size=max_posting)
    a = exact(rows, F.col("addr"))
    b = _number_layer(rows, anchors, names, "country")
    c = _address_layer(best, anchors, names, addresses)
    name = exact(rows, F.col("name"))
    return {"a_exact_address": a, "b_number_name": b, "c_address_name": c, "d_name_plus_b": union(name, b), "e_name_plus_c": union(name, c)}


def canonical(records: DataFrame) -> DataFrame:
    return records.select("entity_id", "src", N.canonical_address(F.col("business_address")).alias("address"), N.canonical_country(F.col("country")).alias("ctry"))


def shared_tokens(s1: DataFrame, ref: DataFrame, least: int) -> DataFrame:
    """Pairs that share at least so many (country, token)."""
    pairs = _pairs(s1, ref, ["country", "token"])
    return pairs.groupBy("s1_id", "cand_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("s1_id", "cand_id")


def df_limit(ref: DataFrame, fraction: float, least: int) -> DataFrame:
    """One row with the greatest document frequency that a token may have."""
    return ref.agg(F.greatest(F.lit(least), F.floor(F.count("*") * F.lit(fraction))).cast("long").alias("limit"))


def address_tokens(records: DataFrame, **changes) -> DataFrame:
    """Rare address tokens: a cap on frequency, then a cap on buckets over all countries, then the rarest of each side."""
    config = BlockConfig(**changes)
    s1, ref = _split(kept(canonical(records).where("address <> ''")))
    s1_tok, ref_tok = (exploded(x, N.tokens(F.lower("address"))) for x in (s1, ref))
    df = document_frequency(ref_tok).crossJoin(F.broadcast(df_limit(ref, config.df_fraction, 1))).where(F.col("df") <= F.col("limit")).select("token", "df")
    buckets = capped(ref_tok.join(df.select("token"), "token", "left_semi"), config.bucket_cap, ("token",), ("entity_id",))
    return shared_tokens(rarest(s1_tok, df, config.s1_k), rarest(buckets, df, config.ref_k), config.min_shared)


def purged_address_tokens(records: DataFrame, **changes) -> DataFrame:
    """As address_tokens, but whole buckets that are too large go, on both sides, and tokens are ASCII."""
    config = BlockConfig(**changes)
    s1, ref = _split(kept(canonical(records)))
    s1_tok, ref_tok = (exploded(x, N.alnum_tokens(F.col("address"))) for x in (s1, ref))
    df = document_frequency(ref_tok).crossJoin(F.broadcast(df_limit(ref, config.df_fraction, 0))).where((F.col("df") <= F.col("limit")) & (F.col("df") <= config.bucket_cap)).select("token", "df")
    return shared_tokens(rarest(s1_tok, df, config.ref_k), rarest(ref_tok, df, config.ref_k), config.min_shared)
