"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

The text speaks through letter trigrams counted over the whole corpus under its declared languages. A first pass stores one
line of log-likelihoods per row; grouped aggregation over those lines then gives how declarations and
suffixes go with languages, and how languages are spread over hosts, smoothed from global to domain
to host. The second pass adds the evidence up.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import staged

NOT_LETTERS = re.compile(r"[\W\d_]+")
MOST_WORDS = 300_000
#: The class of all languages that no row declares; no tag is empty.
OTHER = ""


@dataclass(frozen=True)
class Config:
    """trigrams: those commonest over all languages; own_trigrams: those commonest in each one. Together they are the model."""

    trigrams: int = 20_000
    own_trigrams: int = 1_000
    #: Share of trigrams that a language without any declared text is expected to have beyond the model's.
    unknown: float = 0.3
    #: Odds that a text is in such a language before it is read; a few letters alone do not overcome them.
    undeclared: float = 0.001
    #: Trigrams count as so many independent observations at most.
    effective: float = 30.0
    smoothing: float = 20.0
    least_letters: int = 3
    least_posterior: float = 0.5


def trigrams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


def words_of(text: str) -> list[str]:
    """Letter runs of a text, lower-cased."""
    return NOT_LETTERS.sub(" ", text).lower().split()


def normal_tag(tag: Column) -> Column:
    """'EN-us' -> 'en'; null and empty tags are null."""
    short = F.lower(F.regexp_extract(F.coalesce(tag.cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[^A-Za-z]|$)", 1))
    return F.when(short != "", short)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def domain_of(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&#?\w{1,31};", " ")


def declared_in(html: Column) -> Column:
    return F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)", 1)


def _count(rows: DataFrame) -> DataFrame:
    """(tag, gram, n): each task counts words by declared language and takes them apart once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, Counter] = defaultdict(Counter)
        words: dict[str, Counter] = defaultdict(Counter)

        def fold() -> None:
            for tag, counted in words.items():
                total = grams[tag]
                for w, n in counted.items():
                    for g in trigrams(w):
                        total[g] += n
            words.clear()

        for b in batches:
            for tag, t in zip(b.column(0).to_pylist(), b.column(1)):
                words[tag].update(words_of(t.as_py() or ""))
            if sum(map(len, words.values())) > MOST_WORDS:
                fold()
            if sum(map(len, grams.values())) > 4 * MOST_WORDS:
                yield from out(grams)
                grams.clear()
        fold()
        yield from out(grams)

    def out(grams: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for tag, total in grams.items():
            arrays = [pa.array([tag] * len(total)), pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["tag", "gram", "n"])

    tagged = rows.where("tag IS NOT NULL").select("tag", "t")
    return tagged.mapInArrow(run, "tag string, gram string, n long").groupBy("tag", "gram").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, how: Config = Config()) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, trigrams ('' stands for all others) and their log-probabilities (trigram, language), from (tag, t).

    Languages are all declared tags, however rare; the last one is ``OTHER``. Counts cover all tagged rows and whole
    texts, and each count is smoothed by the same half, so a tag with little text claims little. ``OTHER`` has the
    mean of all languages, flattened, and a larger share of trigrams beyond the model. A language's prior is not part of it.
    """
    tags = rows.where("tag IS NOT NULL").select("tag").distinct().collect()  # two or three letters each
    languages = sorted(r["tag"] for r in tags)
    if not languages:
        return [], [], np.zeros((0, 0))
    counts = staged(_count(rows), "trigram-counts")
    whole = {r["tag"]: r["n"] for r in counts.groupBy("tag").agg(F.sum("n").alias("n")).collect()}
    common = counts.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(how.trigrams).select("gram")
    place = Window.partitionBy("tag").orderBy(F.desc("n"), "gram")
    own = counts.withColumn("place", F.row_number().over(place)).where(F.col("place") <= how.own_trigrams).select("gram")
    chosen = F.broadcast(common.unionByName(own).distinct())
    got = counts.join(chosen, "gram").select("tag", "gram", "n").toArrow()
    grams = sorted(set(got.column("gram").to_pylist()))
    at, column = {g: i for i, g in enumerate(grams)}, {x: i for i, x in enumerate(languages)}
    seen = np.zeros((len(grams) + 1, len(languages)))
    row = np.fromiter((at[g] for g in got.column("gram").to_pylist()), np.int64, got.num_rows)
    seen[row, np.fromiter((column[x] for x in got.column("tag").to_pylist()), np.int64, got.num_rows)] = got.column("n").to_numpy()
    total = np.array([float(whole.get(x, 0)) for x in languages])
    seen[-1] = total - seen.sum(axis=0)
    smooth = 0.5
    seen += smooth
    seen /= total + smooth * len(seen)
    flat = np.sqrt(seen[:-1].mean(axis=1))
    other = np.append(flat * ((1 - how.unknown) / max(flat.sum(), 1e-300)), how.unknown)
    return [*languages, OTHER], [*grams, ""], np.log(np.concatenate([seen, other[:, None]], axis=1)).astype(np.float32)


def likelihoods(rows: DataFrame, languages: list[str], grams: list[str], table: np.ndarray, how: Config = Config()) -> DataFrame:
    """``rows`` (id, tag, host, t) -> (id, tag, host, letters, ll array): tempered log-likelihood per language, 0 at best."""
    shared = rows.sparkSession.sparkContext.broadcast((grams, table))  # trigrams x languages numbers
    k = len(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_, table = shared.value
        model_ = {g: i for i, g in enumerate(grams_)}
        other = model_[""]
        index: dict[str, int] = {}
        sums = np.zeros((1 << 14, k))
        lengths = np.zeros(1 << 14, dtype=np.int64)
        for b in batches:
            letters, lls = [], []
            for t in b.column(3):
                words = words_of(t.as_py() or "")
                letters.append(sum(map(len, words)))
                ids = []
                for w in words:
                    i = index.get(w)
                    if i is None:
                        i = index[w] = len(index)
                        if i >= len(sums):
                            sums, lengths = np.concatenate([sums, np.zeros_like(sums)]), np.concatenate([lengths, np.zeros_like(lengths)])
                        grams = [model_.get(g, other) for g in trigrams(w)]
                        sums[i], lengths[i] = table[grams].sum(axis=0, dtype=np.float64), len(grams)
                    ids.append(i)
                at = np.array(ids, dtype=np.int64)
                n = lengths[at].sum()
                ll = sums[at].sum(axis=0) * min(1.0, how.effective / max(1, n))
                ll[-1] += np.log(how.undeclared)
                lls.append((ll - ll.max()).tolist())
                if len(index) > MOST_WORDS:
                    index.clear()
            arrays = [b.column(0), b.column(1), b.column(2), pa.array(letters, pa.int64()), pa.array(lls, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "tag", "host", "letters", "ll"])

    return rows.select("id", "tag", "host", "t").mapInArrow(run, "id long, tag string, host string, letters long, ll array<double>")


def _log_rates(first: DataFrame, given: str, languages: list[str], kappa: float) -> DataFrame:
    """(given, e array): log P(given | language), smoothed towards P(given), from the text's own decisions."""
    names = [f"in_{x}" for x in languages]
    joint = first.groupBy(given).agg(*[F.sum((F.col("best") == x).cast("double")).alias(f"in_{x}") for x in languages])
    joint = joint.withColumn("all", F.aggregate(F.array(*[F.coalesce(F.col(x), F.lit(0.0)) for x in names]), F.lit(0.0), lambda a, b: a + b))
    per = joint.agg(*[F.sum(x).alias(x) for x in [*names, "all"]]).first()
    total = max(1.0, per["all"] or 0.0)
    e = F.array(*[F.log((F.col(x) + kappa * (F.col("all") + 1) / (total + 1)) / ((per[x] or 0.0) + kappa)) for x in names])
    return joint.select(F.col(given).alias(f"{given}_"), F.when(F.col(given).isNotNull(), e).alias(f"{given}_e"))


def identify(docs: DataFrame, how: Config = Config()) -> DataFrame:
    """Language of each row of ``docs`` (id long, t string, tag string, host string, any of them null).

    Returns id, declared, language, posterior, letters, kept; one row per row of ``docs``. tag is the
    declared language, host the host or source; suffix and domain come from the host. language is null and
    the row is rejected where there is nothing to read (fewer than ``least_letters`` letters: null, empty or
    symbols only), no language reaches ``least_posterior``, or the text is most likely in a language that no row
    declares. Ties go to the language first in order.
    Without any declared language in the table nothing can be told apart: all languages are null, and rows
    with letters are kept. Repeated rows are judged each; an empty table gives no rows.
    """
    rows = docs.select(
        F.col("id").cast("long").alias("id"), normal_tag(F.col("tag")).alias("tag"), F.col("host").cast("string").alias("host"),
        F.col("t").cast("string").alias("t"),
    )
    languages, grams, table = train(rows, how)
    first = likelihoods(rows, languages, grams, table, how) if languages else rows.select(
        "id", "tag", "host", F.char_length(F.regexp_replace(F.coalesce("t", F.lit("")), r"[^\p{L}]", "")).cast("long").alias("letters"),
        F.array().cast("array<double>").alias("ll"),
    )
    readable = F.col("letters") >= how.least_letters
    if not languages:
        none = F.lit(None)
        return first.select("id", F.col("tag").alias("declared"), none.cast("string").alias("language"), none.cast("double").alias("posterior"), "letters", readable.alias("kept"))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    first = first.withColumns({"best": F.when(readable, best(F.col("ll"))), "suffix": suffix_of(F.col("host")), "domain": domain_of(F.col("host"))})
    first = staged(first, "language-evidence")
    for given in ("tag", "suffix"):
        rates = _log_rates(first, given, languages, how.smoothing)
        first = first.join(rates, F.col(given).eqNullSafe(F.col(f"{given}_")), "left").drop(f"{given}_")
    names_ = [f"in_{x}" for x in languages]
    # Priors from global to domain to host, each level drawn towards the one above.
    share = lambda up, total: {x: (F.col(x) + how.smoothing * up(x)) / (F.col(total) + how.smoothing) for x in names_}
    hits = [F.sum((F.col("best") == x).cast("double")).alias(n) for x, n in zip(languages, names_)]
    per_host = staged(first.where("best IS NOT NULL").groupBy("host", "domain").agg(*hits, F.count("*").alias("n")), "hosts")
    world = per_host.agg(*[F.sum(x).alias(x) for x in names_], F.sum("n").alias("n")).first()
    every = {x: ((world[x] or 0.0) + 1.0) / ((world["n"] or 0) + len(languages)) for x in names_}
    per_domain = per_host.groupBy("domain").agg(*[F.sum(x).alias(x) for x in names_], F.sum("n").alias("n"))
    per_domain = per_domain.select(F.col("domain").alias("d"), *[v.alias(f"d_{x}") for x, v in share(lambda x: F.lit(every[x]), "n").items()])
    hosts = per_host.join(per_domain, F.col("domain").eqNullSafe(F.col("d"))).select(
        F.col("host").alias("h"), F.array(*[F.log(v) for v in share(lambda x: F.col(f"d_{x}"), "n").values()]).alias("host_e")
    )
    first = first.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    prior = F.coalesce("host_e", F.array(*[F.log(F.lit(every[x])) for x in names_]))
    flat = F.array(*[F.lit(0.0)] * len(languages))
    total = prior
    for part in (F.col("ll"), F.coalesce("tag_e", flat), F.coalesce("suffix_e", flat)):
        total = F.zip_with(total, part, lambda x, y: x + y)
    scored = first.withColumn("total", total)
    peak = F.array_max("total")
    norm = F.aggregate("total", F.lit(0.0), lambda acc, x: acc + F.exp(x - peak))
    sure = (1.0 / norm) >= how.least_posterior
    told = readable & sure & (best(F.col("total")) != OTHER)
    return scored.select(
        "id", F.col("tag").alias("declared"), F.when(told, best(F.col("total"))).alias("language"), (1.0 / norm).alias("posterior"),
        "letters", told.alias("kept"),
    )


def identify_documents(docs: DataFrame, how: Config = Config()) -> DataFrame:
    """``identify`` over documents: the declared language is column lang, the host is the source."""
    return identify(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t"), F.col("lang").alias("tag"), F.col("source").alias("host")), how)


def identify_pages(pages: DataFrame, how: Config = Config()) -> DataFrame:
    """``identify`` over raw pages: the declared language is the markup's, the host is the address's."""
    host = host_of(F.col("url"))
    return identify(pages.select(F.col("page_id").alias("id"), visible_text(F.col("html")).alias("t"), declared_in(F.col("html")).alias("tag"), host.alias("host")), how)
