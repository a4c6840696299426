"""Removal of lines that equal an earlier line of the corpus or are one edit away from one.

Lines are compared in lower case with runs of blanks folded; blank lines always stay. A line
goes if an earlier one (by id, then line number) is equal or, for lines of at least
``near_from`` characters, within one inserted, deleted or replaced character, whether or not
that earlier line stays itself.

Equal lines are summed up by a 128-bit hash before anything else, so a line that a third of all
rows hold costs one row per task. What is left is a deletion-neighbourhood join. A coarse round
deletes one half of each line: lines within one edit share a half, and only lines whose halves
occur twice go on. For these all variants with one character deleted are emitted as hashed keys,
put together from hashes of blocks, so a line costs its length times the block size. Lines that
share a variant by deleting the same place differ in that place only; a line that equals a
variant of another is one deletion away. Such groups are never paired: each member meets the
earliest line of its group, and the edit distance of the two is verified.

Nulls: a null text is empty; null ids come last. Rows equal in id and text are one document and
get the same result; rows of one id with other texts are documents of their own. An empty table
gives an empty table. Other columns stay; a column that has a result's name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpora.llm.expressions import let
from corpora.llm.lookup import document_key, passing
from corpora.session import materialize

#: Runs of blanks within a line, but for single spaces.
_BLANKS = r"(?:\x20[\x20\x09\x0B-\x0D]|[\x09\x0B-\x0D])[\x20\x09\x0B-\x0D]*+"
_BLOCK = 64


def keyed_texts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``k`` (the document) and ``t`` (its text, empty for null)."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id).alias("id"), document_key(id, body).alias("k"), body.alias("t"))


def line_table(texts: DataFrame) -> DataFrame:
    """One row per line that is not blank: its place, plain form and hashes.

    Case and blanks are folded in the whole text, before it is split.
    """
    plain = F.regexp_replace(F.lower("t"), _BLANKS, " ")
    lines = texts.select("id", "k", F.posexplode(F.split(plain, "\n")).alias("n", "line"))
    lines = lines.select("id", "k", "n", F.trim("line").alias("line")).where("line <> ''")
    return lines.select(
        "*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
        F.struct(F.col("id").isNull().alias("z"), "id", "k", "n").alias("place"),
    )


def _half_keys(line: Column, size: Column) -> Column:
    """Hashes of the line without one half; lines within one edit have one in common.

    Halves are taken at half the length, and at half of one less for a partner that is one shorter.
    """

    def keys(half: Column) -> Column:
        ends = {"a": F.left(line, half), "b": F.right(line, half)}
        return F.array(*[F.xxhash64(F.lit(side), half, part) for side, part in ends.items()])

    own, less = F.floor(size / 2).cast("int"), F.floor((size - 1) / 2).cast("int")
    return F.array_distinct(F.concat(keys(own), keys(less)))


def distinct_lines(lines: DataFrame, near_from: int) -> DataFrame:
    """One row per distinct line: hashes, earliest place, and the keys of its halves if long enough."""
    size = F.length("line")
    keys = F.when(size >= near_from, _half_keys(F.col("line"), size))
    rows = lines.select("h1", "h2", "place", keys.alias("keys"))
    return rows.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.first("keys").alias("keys"))


def _xor(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _block_size(size: Column) -> Column:
    """Size of the blocks that hash a string of ``size`` characters."""
    return F.greatest(F.lit(_BLOCK), F.ceil(F.sqrt(size))).cast("int")


def _blocks(size: Column, block: Column) -> Column:
    count = F.ceil(size / block).cast("int")
    return F.filter(F.sequence(F.lit(0), count), lambda j: j < count)


def whole_hash(line: Column) -> Column:
    """Hash of a string by its blocks."""

    def of_blocks(block: Column) -> Column:
        return _xor(
            F.transform(
                _blocks(F.length(line), block),
                lambda j: F.xxhash64(F.substring(line, j * block + 1, block), j),
            )
        )

    return let(_block_size(F.length(line)), of_blocks)


def deletion_hashes(line: Column) -> Column:
    """For each place of a string the hash, by blocks, of the string without the character there.

    Blocks before the place are the string's own, blocks after it start one character later.
    """

    def of_blocks(block: Column) -> Column:
        def of_parts(parts: Column) -> Column:  # each block and the character after it
            own = F.transform(parts, lambda p, j: F.xxhash64(F.left(p, block), j))
            later = F.transform(parts, lambda p, j: F.xxhash64(F.substring(p, F.lit(2), block), j))

            def around(own: Column, later: Column) -> Column:
                return F.transform(
                    parts,
                    lambda p, b: _xor(F.slice(own, F.lit(1), b)).bitwiseXOR(
                        _xor(F.slice(later, b + 2, F.size(later)))
                    ),
                )

            def of_places(rest: Column) -> Column:
                def without(p: Column, b: Column) -> Column:
                    inside = F.least(F.length(p), block)
                    # the last block may end the string: then its extra character is its own
                    last = (b == F.size(parts) - 1) & (F.length(p) > block)
                    places = F.when(last, inside + 1).otherwise(inside)
                    return F.transform(
                        F.filter(F.sequence(F.lit(0), places), lambda i: i < places),
                        lambda i: F.get(rest, b).bitwiseXOR(
                            F.xxhash64(F.concat(F.left(p, i), F.substring(p, i + 2, block)), b)
                        ),
                    )

                return F.flatten(F.transform(parts, without))

            return let(own, lambda o: let(later, lambda l: let(around(o, l), of_places)))

        cut = F.transform(
            _blocks(F.length(line) - 1, block), lambda j: F.substring(line, j * block + 1, block + 1)
        )
        return let(cut, of_parts)

    return let(_block_size(F.length(line) - 1), of_blocks)


def _near_texts(texts: DataFrame, distinct: DataFrame) -> DataFrame:
    """First occurrences, with text, of lines that share a half with another line.

    Only documents that hold one of them are split again; they are filtered where they are read.
    """
    halves = distinct.where("keys is not null").select("h1", "h2", "first", F.explode("keys").alias("key"))
    shared = halves.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    near = materialize(halves.join(shared, "key", "left_semi").select("h1", "h2", "first").distinct(), "near-lines")
    holding = passing(texts, "k", near.select(F.col("first.k").alias("k")))
    lines = line_table(holding).select("line", "h1", "h2", F.col("k").alias("lk"), F.col("n").alias("ln"))
    firsts = near.select(
        F.col("h1").alias("a"), F.col("h2").alias("b"), "first", F.col("first.k").alias("fk"), F.col("first.n").alias("fn")
    )
    same = (
        (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b"))
        & (F.col("lk") == F.col("fk")) & (F.col("ln") == F.col("fn"))
    )
    joined = lines.join(firsts, same).select("h1", "h2", "first", "line")
    return materialize(joined.dropDuplicates(["h1", "h2"]), "near-texts")


def near_lines(documents: DataFrame, distinct: DataFrame) -> DataFrame:
    """Hashes of the distinct lines that have an earlier line within one edit."""
    texts = _near_texts(documents, distinct)
    size = F.length("line")
    deleted = F.transform(
        deletion_hashes(F.col("line")),
        lambda h, i: F.struct(h.alias("hash"), (F.length("line") - 1).alias("size"), i.alias("at")),
    )
    itself = F.array(F.struct(whole_hash(F.col("line")).alias("hash"), size.alias("size"), F.lit(-1).alias("at")))
    variants = texts.select("first", F.explode(F.concat(deleted, itself)).alias("v")).select("first", "v.*")
    alike = Window.partitionBy("hash", "size")
    at_place = Window.partitionBy("hash", "size", "at")
    whole = F.min(F.when(F.col("at") == -1, F.col("first"))).over(alike)
    shorter = F.min(F.when(F.col("at") >= 0, F.col("first"))).over(alike)
    met = variants.select(
        "first", "at", F.min("first").over(at_place).alias("same_place"), whole.alias("whole"),
        shorter.alias("shorter"),
    )
    partner = F.when(F.col("at") == -1, F.array("shorter")).otherwise(F.array("same_place", "whole"))
    pairs = met.select("first", F.explode(partner).alias("other"))
    pairs = pairs.where("other is not null and other < first").distinct()
    one = texts.select(F.col("first").alias("f1"), F.col("line").alias("l1"), "h1", "h2")
    two = texts.select(F.col("first").alias("f2"), F.col("line").alias("l2"))
    read = pairs.join(one, _same_place("first", "f1")).join(two, _same_place("other", "f2"))
    close = F.levenshtein("l1", "l2", 1)
    return read.where((close >= 0) & (close <= 1)).select("h1", "h2").distinct()


def _same_place(a: str, b: str) -> Column:
    return (F.col(f"{a}.k") == F.col(f"{b}.k")) & (F.col(f"{a}.n") == F.col(f"{b}.n"))


def deduplicated_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", near_from: int = 20, max_edits: int = 1
) -> DataFrame:
    """``docs`` with ``text`` without removed lines, ``n_lines`` and ``n_kept``.

    ``max_edits`` is 1, or 0 for equal lines only.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    texts = keyed_texts(docs, id, text)
    distinct = materialize(distinct_lines(line_table(texts), near_from), "distinct-lines")
    kept = distinct.select("h1", "h2", "first")
    if max_edits:
        gone = near_lines(texts, distinct).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"))
        kept = kept.join(gone, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left_anti")
    places = kept.groupBy(F.col("first.k").alias("k")).agg(F.collect_list("first.n").alias("kept"))
    # the caller's columns travel as one, so that their names meet no others
    others = [c for c in docs.columns if c not in (text, "n_lines", "n_kept")]
    body = F.coalesce(F.col(text), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")
    keyed = docs.select(row, body.alias("body"), document_key(id, body).alias("key"))
    joined = keyed.join(places, F.col("key") == F.col("k"), "left")

    def rebuilt(split: Column) -> Column:
        blank = F.filter(
            F.transform(split, lambda x, i: F.when(~x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull()
        )
        order = F.array_sort(F.concat(F.coalesce(F.col("kept"), F.array().cast("array<int>")), blank))
        return F.struct(
            F.array_join(F.transform(order, lambda i: F.get(split, i)), "\n").alias("text"),
            F.size(split).cast("long").alias("n_lines"), F.size(order).cast("long").alias("n_kept"),
        )

    made = joined.select("row", let(F.split("body", "\n"), rebuilt).alias("made"))
    texts = [F.col("made.text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c == text or c in others]
    return made.select(*texts, "made.n_lines", "made.n_kept")
