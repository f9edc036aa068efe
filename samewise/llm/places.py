"""Address records that denote the same building or plot.

Addresses are read into parts, equal readings are taken together, and the distinct readings are banded by
MinHash over tokens and q-grams that carry the house number. Readings that share a band are verified by
affine-gap token alignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.llm.addresses import Address, read_address, same_place
from samewise.llm.components import hash_to_min
from samewise.operators.hot import join, salted_pairs
from samewise.session import cut, drop, spread

PARTS = ["number", "street", "kind", "town", "region", "postcode", "tokens"]
READING = ", ".join(f"{p} string" for p in PARTS)
#: Bands and rows of a band: with three tenths of the shingles in common a pair is found with a chance of 95 in 100.
BANDS, ROWS = 32, 2
_P = np.uint64((1 << 61) - 1)


def read_addresses(df: DataFrame, key: str, address: str, country: str) -> DataFrame:
    """``id`` and the parts of each row's address; rows without a key, a house number or a street are left out."""
    kind = df.select(F.col(f"`{key}`").alias("id")).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, r) for i, a, c in zip(*(batch.column(k).to_pylist() for k in range(3))) if (r := read_address(a, c)).number and r.street]
            parts = [pa.array([getattr(r, p) for _, r in rows], pa.string()) for p in PARTS]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], batch.schema.field(0).type), *parts], names=["id", *PARTS])

    texts = [F.col(f"`{c}`").cast("string").alias(f"__{k}") for k, c in enumerate((address, country))]
    return spread(df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("id"), *texts)).mapInArrow(run, f"id {kind}, {READING}")


def shingles(number: str, street: str, town: str, postcode: str) -> list[int]:
    """Hashes of tokens and q-grams, each with the house number; repeated ones are weighted by a count."""
    padded = f"^{street}$"
    own = {padded[i : i + 3] for i in range(len(padded) - 2)} | {f"={street}", "~" + "".join(sorted(street)), "~~" + "".join(sorted(street)), "." + "".join(c for c in street if c not in "aeiou")}
    if postcode:
        own |= {f"p{k}{postcode}" for k in range(3)}
    if town:
        own |= {f"t{k}{town}" for k in range(2)}
    return [xxhash.xxh64_intdigest(f"{number}|{x}") for x in own]


def band_keys(sets: list[list[int]], bands: int = BANDS, rows: int = ROWS) -> list[list[int]]:
    """The band keys of each set of hashes; an empty set has none."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    out = []
    for s in sets:
        if not s:
            out.append([])
            continue
        h = np.array(s, np.uint64)
        mixed = (h[:, None] ^ (h[:, None] >> np.uint64(29))) * a + b  # wraps
        least = (mixed ^ (mixed >> np.uint64(32))).min(axis=0).reshape(bands, rows)
        key = np.zeros(bands, np.uint64)
        for r in range(rows):
            key = key * np.uint64(0x100000001B3) + least[:, r]
        out.append(((key + np.arange(bands, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).tolist())
    return out


def _bands(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for number, street, town, postcode in batches:
        sets = [shingles(*x) if x[0] and x[1] else [] for x in zip(number, street, town, postcode)]
        yield pd.Series(band_keys(sets))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        keep = [i for i, r in enumerate(rows) if same_place(Address(**r["ra"]), Address(**r["rb"]))]
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])


def cluster_places(df: DataFrame, key: str, address: str, country: str) -> DataFrame:
    """``id, place``: the place of each key; keys without an address have none.

    A key with several addresses is at each of them. Equal readings are one representative, so a place with a third of
    all rows is compared once; buckets are paired in blocks. Being at one place is an equivalence: readings tied through
    others are one place too.
    """
    read = cut(read_addresses(df, key, address, country).withColumn("form", F.xxhash64(*PARTS)).distinct(), "addresses")
    forms = cut(read.select("form", *PARTS).dropDuplicates(["form"]), "forms")
    bands = F.pandas_udf(_bands, "array<bigint>")
    banded = cut(forms.select("form", F.explode(bands("number", "street", "town", "postcode")).alias("band")).distinct(), "bands")
    pairs = cut(salted_pairs(banded, ["band"], "form").select("a", "b").distinct(), "pairs")
    sides = [forms.select(F.col("form").alias(x), F.struct(*PARTS).alias(f"r{x}")) for x in "ab"]
    links = join(join(pairs, sides[0], "a"), sides[1], "b").select("a", "b", "ra", "rb").mapInArrow(_verify, "a bigint, b bigint")
    place = hash_to_min(links)
    out = cut(join(read.select("form", "id"), place, F.col("form") == F.col("node"), "left").select(F.coalesce("component", "form").alias("place"), "id").distinct(), "places")
    for t in (read, forms, banded, pairs):
        drop(t)
    return out


def same_places(df: DataFrame, key: str, address: str, country: str) -> DataFrame:
    """``id_a, id_b``: pairs of different keys whose addresses denote the same place, the smaller key first.

    Rows with a NULL key, and rows whose address is NULL, empty or without house number and street, are in no
    pair. Repeated rows count once. The pairs are written from :func:`cluster_places`, which gives one row for each key.
    """
    return salted_pairs(cluster_places(df, key, address, country), ["place"], "id").select(F.col("a").alias("id_a"), F.col("b").alias("id_b")).distinct()
