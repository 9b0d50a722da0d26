"""Language ID by Bayesian evidence fusion.

The posterior of a language is, up to a constant, the product of

* the text's likelihood under the language's model: trigrams of bytes (letters lower-cased, other ASCII as blanks), hashed
  to ``BUCKETS`` cells, with smoothed frequencies learnt from all labelled documents; its logarithm is scaled down for long
  texts so that it weighs at most ``TEXT_WEIGHT`` trigrams, all of which count;
* the likelihood of the declared language (markup, or a column): right with probability ``DECLARED``;
* the likelihood of the address suffix: how often pages of that language have it, by grouped aggregation;
* the host's prior: the posterior mass of the host's other pages by text and declaration, smoothed towards its domain's,
  that towards the whole collection's, each with ``SMOOTH`` pseudo-pages.

Besides the languages there is a class ``OTHER`` for what is none of them. Its text model gives all cells the same
frequency, so a text whose trigrams are on average rarer in every language than in even noise falls to it; a declared
language that is not among the languages counts for it as a declared one counts for its own; suffix and host count alike.

A row is rejected when it has no trigram and no declaration, when ``OTHER`` is the likeliest class, or when no language
reaches ``MIN_POSTERIOR``.

Scale: texts are read by narrow maps and leave one vector of log-likelihoods a row, written to spark.checkpoint.dir. Hosts
are aggregated with partial sums. Priors come back by host: hosts with over 1/``HEAVY`` of the rows, fewer than ``HEAVY`` of
them, by broadcast, the others by a shuffled join in which heavy rows take a spread-out key. The driver gets the trigram
table (languages x ``BUCKETS``) and nothing that grows with the rows.

Results by definition: null or empty texts have no text evidence; declarations count by their first subtag (``en-US`` is
``en``); null declarations, those that are no code of two or three letters and ``und``, ``mul`` and ``mis`` give no evidence,
nor do null addresses; rows without a host share the collection's prior; equal rows are separate rows; an empty table gives no rows;
without labelled documents all classes have equal text evidence; other columns are ignored. A text that is labelled with a
wrong language trains that language too, which shows where a language has few more trigrams than the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.llm.store import shared_folder
from lapidary.llm.text import Chunk, bounded_batches, chunks

LANGUAGES = ("de", "en", "es", "fr")
OTHER = "other"
#: Codes of three letters for languages that have one of two, and codes that name no language.
LONG_CODES = {"deu": "de", "ger": "de", "eng": "en", "spa": "es", "fra": "fr", "fre": "fr"}
NO_LANGUAGE = ("und", "mul", "mis")
BUCKETS = 1 << 14
TEXT_WEIGHT = 40.0
DECLARED = 0.9
SMOOTH = 5.0
MIN_POSTERIOR = 0.5
HEAVY = 1024
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
_FOLD[ord("A") : ord("Z") + 1] += 32


def trigrams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Cell and text of every trigram that holds a letter and lies within one text."""
    b = _FOLD[chunk.buf].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    # the middle byte is a letter's, so that blanks between words don't count twice
    inner = np.flatnonzero(b[1:-1] != 0x20)
    doc = chunk.owner(inner)
    whole = inner + 3 <= chunk.bounds[doc + 1]
    inner, doc = inner[whole], doc[whole]
    cell = (key[inner] * np.uint32(2654435761)) >> np.uint32(18)
    return cell.astype(np.int64), doc


def train(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, text_col: str = "text", lang_col: str = "lang") -> np.ndarray:
    """Log frequencies, language x cell, from all documents that bear one of the languages."""
    bounded_batches(docs.sparkSession)
    place = F.array_position(F.array(*map(F.lit, languages)), F.col(lang_col).cast("string")) - 1
    rows = docs.select(F.col(text_col).cast("string").alias("text"), place.cast("int").alias("place")).where("place >= 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        for chunk in chunks(batches):
            cell, doc = trigrams(chunk)
            place = chunk.rows.column("place").to_numpy()
            total += np.bincount(place[doc] * BUCKETS + cell, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    found = np.zeros(len(languages) * BUCKETS)
    for row in rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        found[row["at"]] = row["n"]
    found = found.reshape(len(languages), BUCKETS) + 0.5
    return np.log(found / found.sum(axis=1, keepdims=True))


_CODE = re.compile(r"([a-z]{2,3})(?![^-_])")
_HTML = re.compile(r"(?i)<html\b")
_LANG = re.compile(r"""(?i)\blang\s*=\s*["']?([a-z]+)""")
_SILENT = re.compile(r"(?i)<(script|style|noscript|template|head|nav)\b")
_CLOSE = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "noscript", "template", "head", "nav")}


def visible(source: str) -> str:
    """The text outside tags, comments and elements that show none, a blank for each.

    One pass: what is looked for and not found is not looked for again, so the time is linear in the length.
    """
    out, at, missing = [], 0, set()
    while True:
        tag = source.find("<", at)
        if tag < 0:
            out.append(source[at:])
            return "".join(out)
        out.append(source[at:tag])
        end = -1
        if source.startswith("<!--", tag) and "--" not in missing:
            end = source.find("-->", tag + 4) + 3
            if end == 2:
                missing.add("--")
        silent = _SILENT.match(source, tag)
        if silent and silent[1].lower() not in missing:
            name = silent[1].lower()
            close = _CLOSE[name].search(source, silent.end())
            if close:
                end = close.end()
            else:
                missing.add(name)
        if end < 3:
            end = source.find(">", tag) + 1
            if not end:  # no tag ends any more
                out.append(source[tag:])
                return "".join(out)
        out.append(" ")
        at = end


def declared_language(source: str) -> str | None:
    """The language that the page's html tag names."""
    at = 0
    while found := _HTML.search(source, at):
        at = source.find(">", found.end())
        at = len(source) if at < 0 else at
        lang = _LANG.search(source, found.end(), at)
        if lang:
            return lang[1].lower()
    return None


def read_page(source: str | None) -> tuple[str, str | None]:
    """Text and declared language of a page."""
    return (html.unescape(visible(source)), declared_language(source)) if source else ("", None)


def read_address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, domain (its last two labels) and suffix (the last)."""
    try:
        host = urlsplit(url).hostname if url else None
    except ValueError:
        host = None
    if not host:
        return None, None, None
    labels = host.rstrip(".").split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def declared_code(declared: str | None) -> str | None:
    """The language code that a declaration names, null where it is no evidence."""
    found = _CODE.match(declared.strip().lower()) if declared else None
    code = LONG_CODES.get(found[1], found[1]) if found else None
    return None if code in NO_LANGUAGE else code


EVIDENCE = "id long, key long, host string, domain string, suffix string, declared string, code string, n_trigrams long, logs array<double>"
_EVIDENCE = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("host", pa.string()), ("domain", pa.string()), ("suffix", pa.string()), ("declared", pa.string()), ("code", pa.string()), ("n_trigrams", pa.int64()), ("logs", pa.list_(pa.float64()))])


def _rated(chunk: Chunk, model: np.ndarray, columns: list) -> pa.RecordBatch:
    cell, doc = trigrams(chunk)
    n = np.bincount(doc, minlength=len(chunk))
    # the last class, OTHER, has all cells alike
    logs = np.stack([*(np.bincount(doc, row[cell], minlength=len(chunk)) for row in model), n * -np.log(BUCKETS)], axis=1)
    logs -= logs.max(axis=1, keepdims=True)
    logs *= np.minimum(1.0, TEXT_WEIGHT / np.maximum(n, 1))[:, None]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(chunk) + 1) * logs.shape[1], pa.int32()), pa.array(logs.ravel()))
    codes = pa.array([declared_code(x) for x in columns[-1].to_pylist()], pa.string())
    return pa.RecordBatch.from_arrays([chunk.rows.column("id"), *columns, codes, pa.array(n.astype(np.int64)), lists], schema=_EVIDENCE)


def page_evidence(pages: DataFrame, model: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [read_page(x) for x in batch.column("text").to_pylist()]
            where = [read_address(x) for x in batch.column("url").to_pylist()]
            table = pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([t for t, _ in read], pa.string()), *(pa.array([w[i] for w in where], pa.string()) for i in range(3)), pa.array([d for _, d in read], pa.string())],
                names=["id", "text", "host", "domain", "suffix", "declared"],
            )
            for chunk in chunks(iter([table])):
                yield _rated(chunk, model, [pa.nulls(len(chunk), pa.int64()), *(chunk.rows.column(c) for c in ("host", "domain", "suffix", "declared"))])

    return rows.mapInArrow(run, EVIDENCE)


def row_key(text: Column, lang: Column, host: Column) -> Column:
    """A hash of all that a document's verdict depends on, so that rows that share an id are told apart."""
    parts = [c.cast("string") for c in (text, lang, host)]
    # xxhash64 passes over nulls
    return F.xxhash64(*(x for c in parts for x in (c, c.isNull())))


def document_evidence(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", host_col: str = "source") -> DataFrame:
    """As for pages, for plain texts: a column declares the language, another one names the host."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host"), F.lower(F.col(lang_col).cast("string")).alias("declared"), row_key(F.col(text_col), F.col(lang_col), F.col(host_col)).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            none = pa.nulls(len(chunk), pa.string())
            yield _rated(chunk, model, [chunk.rows.column("key"), chunk.rows.column("host"), none, none, chunk.rows.column("declared")])

    return rows.mapInArrow(run, EVIDENCE)


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    total = F.aggregate(logs, F.lit(0.0), lambda n, x: n + F.exp(x - top))
    return F.transform(logs, lambda x: F.exp(x - top) / total)


def _sums(column: str, k: int) -> Column:
    """The sum of each place of an array of k numbers."""
    return F.array(*(F.sum(F.element_at(column, i + 1)) for i in range(k)))


def fuse(evidence: DataFrame, languages: tuple[str, ...] = LANGUAGES, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """One row for each row of evidence: id, language (null where rejected), best (``OTHER`` is one), its posterior, accepted and the parts."""
    names = F.array(*map(F.lit, (*languages, OTHER)))
    k = len(languages) + 1
    zeros = F.array(*[F.lit(0.0)] * k)
    right, wrong = float(np.log(DECLARED)), float(np.log((1 - DECLARED) / max(k - 1, 1)))
    known, spoken = F.col("code").isNotNull(), F.col("code").isin(*languages)
    said = F.transform(names, lambda x: F.when(~known, 0.0).when(F.when(spoken, F.col("code")).otherwise(OTHER) == x, right).otherwise(wrong))
    rows = evidence.withColumn("number", F.monotonically_increasing_id()).withColumn("own", F.zip_with("logs", said, lambda x, y: x + y))
    rows = rows.withColumn("q", _softmax(F.col("own")))

    hosts = rows.where(F.col("host").isNotNull()).groupBy("host").agg(F.max("domain").alias("domain"), F.count("*").alias("host_n"), _sums("q", k).alias("host_mass"))
    domains = hosts.where(F.col("domain").isNotNull()).groupBy("domain").agg(F.sum("host_n").alias("domain_n"), _sums("host_mass", k).alias("domain_mass"))
    priors = hosts.join(domains, "domain", "left").select("host", "host_n", "host_mass", "domain_n", "domain_mass")
    suffixes = rows.groupBy("suffix").agg(F.count("*").alias("suffix_n"), _sums("q", k).alias("suffix_mass"))
    whole = F.broadcast(suffixes.agg(F.sum("suffix_n").alias("all_n"), _sums("suffix_mass", k).alias("all_mass")))  # one row
    rows = _attach(rows, "host", priors, "host_n", whole)
    rows = _attach(rows, "suffix", suffixes.where(F.col("suffix").isNotNull()), "suffix_n", whole).join(whole)

    def smoothed(mass: str, n: str, above: Column) -> Column:
        """The others' mass, without the row's own, and ``SMOOTH`` rows like the level above."""
        others = F.greatest(F.coalesce(n, F.lit(0)) - 1, F.lit(0))
        sums = F.zip_with(F.coalesce(F.col(mass), F.col("q")), "q", lambda m, q: F.greatest(m - q, F.lit(0.0)))
        return F.zip_with(sums, above, lambda m, p: (m + SMOOTH * p) / (others + SMOOTH))

    rows = rows.withColumn("top", F.transform("all_mass", lambda m: (m + 1) / (F.col("all_n") + k)))
    rows = rows.withColumn("middle", smoothed("domain_mass", "domain_n", F.col("top")))
    rows = rows.withColumn("prior", smoothed("host_mass", "host_n", F.col("middle")))
    # how much likelier the suffix is in a language than in all
    share = (F.col("suffix_n") + 1) / (F.col("all_n") + 2)
    suffix = F.when(F.col("suffix_n").isNull(), zeros).otherwise(F.zip_with("suffix_mass", "all_mass", lambda m, a: F.log((m + 1) / (a + 2) / share)))
    rows = rows.withColumn("sum", F.zip_with(F.zip_with("own", "prior", lambda x, p: x + F.log(p)), suffix, lambda x, y: x + y))
    rows = rows.withColumn("p", _softmax(F.col("sum"))).withColumn("posterior", F.array_max("p"))
    rows = rows.withColumn("best", F.element_at(names, F.array_position("p", F.col("posterior")).cast("int")))
    accepted = ((F.col("n_trigrams") > 0) | known) & (F.col("best") != OTHER) & (F.col("posterior") >= min_posterior)
    return rows.select("id", F.when(accepted, F.col("best")).alias("language"), "best", "posterior", accepted.alias("accepted"), "declared", "host", "n_trigrams", "key")


def _attach(rows: DataFrame, key: str, table: DataFrame, count: str, whole: DataFrame) -> DataFrame:
    """Left join on a key of which few values may hold most rows: those by broadcast, the rest by shuffle."""
    heavy = table.join(whole.select("all_n")).where(F.col(count) * HEAVY > F.col("all_n"))
    names = [c for c in table.columns if c != key]
    heavy = F.broadcast(heavy.select(F.col(key).alias("_heavy"), *(F.col(c).alias(f"_{c}") for c in names)))  # fewer than HEAVY rows
    rows = rows.join(heavy, rows[key] == heavy["_heavy"], "left")
    # rows served, or without a key, take one of their own, so that they don't meet
    own = F.when(F.col("_heavy").isNotNull() | F.col(key).isNull(), F.concat(F.lit("\0"), F.col("number").cast("string"))).otherwise(F.col(key))
    rows = rows.withColumn("_key", own).join(table.withColumnRenamed(key, "_key").hint("merge"), "_key", "left")
    return rows.withColumns({c: F.coalesce(f"_{c}", c) for c in names}).drop("_key", "_heavy", *(f"_{c}" for c in names))


def identify(evidence: DataFrame, languages: tuple[str, ...] = LANGUAGES, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """``fuse`` over evidence written to the shared folder, so that texts are read once."""
    spark = evidence.sparkSession
    path = shared_folder(spark, "language")
    evidence.write.parquet(path)
    return fuse(spark.read.parquet(path), languages, min_posterior)
