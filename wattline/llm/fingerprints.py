"""Document fingerprints by consistent weighted sampling. DataFrame functions only.

A text is a set of words weighted by how often they occur. For each of ``samples`` hash functions a word
draws r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1), all from hashes of the word, and with its weight w gives
t = floor(ln w / r + b) and a = c exp(-r (t - b + 1)). The word with the smallest a is drawn, and (word, t)
is one entry of the signature. Two texts agree in an entry with probability sum(min) / sum(max) of
their weights, the generalised Jaccard similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import row_index, staged

SAMPLES, ROUNDS = 64, 32
#: Bits of (word, t) that an entry keeps; unequal entries agree by chance once in 2^16.
BITS = 16
#: ln(a) as a whole number: fraction bits kept when words are compared.
SCALE = float(1 << 40)
SPACE = r"[\x20\x09-\x0D]+"
UNIT = 1.0 / (1 << 25)


def _part(hashed: str, at: int) -> Column:
    """A number in (0, 1) from 25 bits of a hash."""
    return (F.shiftrightunsigned(hashed, at).bitwiseAND((1 << 25) - 1) + F.lit(0.5)) * F.lit(UNIT)


def _drawn(rows: DataFrame, sides: int, per_round: int) -> DataFrame:
    """Columns e{side}_{i}: ln a in the high bits, digest of (word, t) in the low ones, null without the word.

    Each step is a projection of its own, so that what later steps use several times is computed once.
    """
    keys, logs, each = ["k0", "k1", "round"], [f"l{s}" for s in range(sides)], range(per_round)
    at = lambda i: F.col("round") * per_round + i
    hashes = [h for i in each for h in (F.xxhash64("word", at(i)).alias(f"x{i}"), F.xxhash64(at(i), "word").alias(f"y{i}"))]
    rows = rows.select(*keys, "word", *logs, *hashes)
    draws = []
    for i in each:
        x, y = f"x{i}", f"y{i}"
        b = F.shiftrightunsigned(x, 50).bitwiseAND((1 << 14) - 1) * F.lit(2048.0) + F.shiftrightunsigned(y, 50).bitwiseAND(2047) + 0.5
        draws += [(-F.ln(_part(x, 0) * _part(x, 25))).alias(f"r{i}"), F.ln(-F.ln(_part(y, 0) * _part(y, 25))).alias(f"c{i}"), (b * F.lit(UNIT)).alias(f"b{i}")]
    rows = rows.select(*keys, "word", *logs, *draws)
    steps = [F.floor(F.col(lw) / F.col(f"r{i}") + F.col(f"b{i}")).alias(f"t{s}_{i}") for s, lw in enumerate(logs) for i in each]
    rows = rows.select(*keys, "word", *[f"{v}{i}" for i in each for v in "rcb"], *steps)
    entries = []
    for s in range(sides):
        for i in each:
            t = F.col(f"t{s}_{i}")
            log_a = F.col(f"c{i}") - F.col(f"r{i}") * (t - F.col(f"b{i}") + 1.0)
            digest = F.xxhash64("word", t).bitwiseAND((1 << BITS) - 1)
            packed = F.shiftleft((log_a * F.lit(SCALE)).cast("long"), BITS).bitwiseOR(digest)
            entries.append(packed.alias(f"e{s}_{i}"))
    return rows.select(*keys, *entries)


def signatures(texts: DataFrame, sides: int, samples: int = SAMPLES, rounds: int = ROUNDS) -> DataFrame:
    """(key columns k0, k1, fps array of strings) for ``texts`` (k0, k1, t array of texts, one per side).

    Counting words, drawing and taking minima all group by the row's key, by which the rows are
    already dealt out, so one task does all of it for a row. Samples are drawn in ``rounds`` groups. A
    text without words has a signature of zeros.
    """

    def marked(s: int) -> Column:
        return F.transform(F.split(F.element_at("t", s + 1), SPACE), lambda w: F.struct(F.lit(s).alias("s"), w.alias("w")))

    side_words = [marked(s) for s in range(sides)]
    words = texts.select("k0", "k1", F.explode(F.concat(*side_words)).alias("x")).where(F.col("x.w") != "")
    counts = words.select("k0", "k1", "x.s", F.xxhash64("x.w").alias("word")).groupBy("k0", "k1", "word").agg(
        *[F.sum((F.col("s") == s).cast("int")).alias(f"n{s}") for s in range(sides)]
    )
    per_round = samples // rounds
    # ln(0) is null, and so is every entry of a word that the side does not have.
    logged = counts.select("k0", "k1", "word", *[F.ln(F.col(f"n{s}").cast("double")).alias(f"l{s}") for s in range(sides)])
    entries = _drawn(logged.withColumn("round", F.explode(F.array(*[F.lit(i) for i in range(rounds)]))), sides, per_round)
    low = entries.groupBy("k0", "k1", "round").agg(*[F.min(f"e{s}_{i}").alias(f"m{s}_{i}") for s in range(sides) for i in range(per_round)])
    width = BITS // 4
    text = lambda c: F.lpad(F.hex(F.coalesce(F.col(c), F.lit(0)).bitwiseAND((1 << BITS) - 1)), width, "0")
    rows = low.select("k0", "k1", "round", *[F.lower(F.concat(*[text(f"m{s}_{i}") for i in range(per_round)])).alias(f"f{s}") for s in range(sides)])
    at = lambda j, s: F.max(F.when(F.col("round") == j, F.col(f"f{s}")))
    whole = rows.groupBy("k0", "k1").agg(*[F.concat(*[at(j, s) for j in range(rounds)]).alias(f"fp{s}") for s in range(sides)])
    return whole.select("k0", "k1", F.array(*[f"fp{s}" for s in range(sides)]).alias("fps"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal entries of two fingerprints."""
    width = BITS // 4
    same = [(F.substring(a, i * width + 1, width) == F.substring(b, i * width + 1, width)).cast("int") for i in range(samples)]
    return sum(same, F.lit(0)) / F.lit(float(samples))


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: fingerprints of the text and of its edited text, and their likeness.

    Edited text: the last floor(n_chars / 4) code points give way to the first as many (or all) of the
    next document in order of doc_id (null first; equal ids by text hash), after the last the first. Null text
    counts as empty; texts without words have the zero fingerprint and are alike among themselves.
    Rows equal in id and text are one document in that order and give equal results. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = rows.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("k0"), F.xxhash64("text", F.col("doc_id").isNull()).alias("k1"), "doc_id", "text")
    ids = keyed.groupBy("k0", "k1").agg(F.first("doc_id").alias("doc_id"), F.first(F.char_length("text")).cast("long").alias("n_chars"), F.count("*").alias("copies"))
    order = staged(row_index(ids, [F.col("k0"), F.col("k1")]), "document-order")
    n = order.count()
    # Each document owes its beginning to the one before it.
    owes = order.select(F.pmod(F.col("idx") + 1, F.lit(max(n, 1))).alias("idx"), F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.floor(F.col("n_chars") / 4).alias("need"))
    owes = staged(owes.join(order.select("idx", "k0", "k1"), "idx").drop("idx"), "document-neighbours")
    dealt = keyed.select("k0", "k1", "text")
    heads = dealt.join(owes.hint("merge"), ["k0", "k1"]).select(
        F.col("p0").alias("k0"), F.col("p1").alias("k1"), F.substring(F.col("text"), F.lit(1), F.col("need").cast("int")).alias("head")
    ).dropDuplicates(["k0", "k1"])
    both = dealt.join(heads.hint("merge"), ["k0", "k1"])
    chars = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (chars - F.floor(chars / 4)).cast("int")), F.col("head"))
    both = both.withColumn("edited", edited).dropDuplicates(["k0", "k1"])
    hashed = both.select("k0", "k1", F.array("text", "edited").alias("t"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    zero = F.lit("0" * (SAMPLES * BITS // 4))
    return _assemble(hashed, order, n, zero)


def _assemble(hashed: DataFrame, order: DataFrame, n: int, zero: Column) -> DataFrame:
    signed = signatures(hashed.select("k0", "k1", "t"), 2)
    found = staged(hashed.select("k0", "k1", "edited_sha256").join(signed, ["k0", "k1"], "left"), "signatures")
    fp = lambda i: F.coalesce(F.element_at("fps", i + 1), zero)
    own = order.join(found, ["k0", "k1"]).select(
        "idx", "doc_id", "n_chars", "copies", "edited_sha256", fp(0).alias("fingerprint"), fp(1).alias("edited_fingerprint")
    )
    own = staged(own, "fingerprints")
    following = own.select(F.pmod(F.col("idx") - 1, F.lit(max(n, 1))).alias("idx"), F.col("fingerprint").alias("next_fingerprint"))
    out = own.join(following, "idx")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
