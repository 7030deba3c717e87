"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The model learns from a small labelled table of URLs, a parameter; the default is made by rule from word lists. Scoring is array arithmetic on
Arrow batches: n-gram codes of all URLs of a batch at once, one weight look-up, one sum per URL.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.texts import byte_texts, mix64
from cohortloom.session import small_rows

# Fixed values: (verdict, host ending, path beginning).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

# Words of which the default labelled table is made by rule (``labelled_table``).
BLOCK_WORDS = ("casino poker bet bets jackpot slots roulette bingo lottery gamble wager loans loan payday credit debt viagra cialis pills pharmacy diet slim porn xxx adult sex cam "
               "escort dating singles nude hot crack keygen serial warez torrent cheap deals coupon promo discount replica outlet prize winner win claim free gift spam ads ad adclick "
               "track tracker click popup popunder banner redirect crypto forex binary profit invest bonus odds spin scam verify phish hoax clickbait backlink seo").split()
ALLOW_WORDS = ("library museum news wiki garden school health bike kitchen city archive editor weather lab travel history lexicon radio piano court story zoo tutorial farm film census church "
               "writer train printer river forest science music journal atlas harbour village teacher student book paper review letter market winter summer street bridge castle island planet "
               "animal flower engine physics algebra grammar recipe climate council report poem essay forum project").split()
LETTER_PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur sh wh ly".split()
FRONTS = ("", "www.", "m.", "blog.", "shop.", "en.")
ENDS = ("example", "example.com", "example.net", "test", "invalid", "com", "net", "info")
PATHS = ("", "/", "/en/{n}", "/de/{n}/", "/fr/{n}.html", "/es/{n}", "/index.html", "/page/{n}", "/{n}", "/articles/{n}", "/{w}/{n}", "/{w}.html", "/en/{w}/{n}")
MOST_LABELLED = 100_000


def labelled_table(part: int | None = None, parts: int = 5) -> tuple[tuple[str, int], ...]:
    """Invented URLs with labels (1: block). Hosts are one or two words, or a few letter pairs, with usual fronts, ends and paths.

    Every choice follows from the number of the URL, so the table is always the same. ``part`` leaves out every ``parts``-th URL
    (None: none), and a negative one gives only those, for measuring on URLs that have not been learned.
    """
    rows = []
    for label, words in ((1, BLOCK_WORDS), (0, ALLOW_WORDS), (0, None)):
        for i in range(2000):
            draw = mix64(np.arange(8, dtype=np.uint64) + np.uint64(1 + 16 * (i + 4096 * len(words or "x") + label))).astype(object)
            pick = lambda k, of: of[int(draw[k]) % len(of)]  # noqa: B023, E731
            if words is None:
                name = "".join(pick(k, LETTER_PAIRS) for k in range(2 + int(draw[5]) % 3))
                word = pick(6, LETTER_PAIRS) + pick(7, LETTER_PAIRS)
            else:
                one, two, joint = pick(0, words), pick(1, words), pick(2, ("-", "", None, None if label else "-"))
                tail = pick(3, ("", "", "", "24", "x", "-online", "-x"))
                name = (one if joint is None else one + joint + two) + tail
                word = pick(7, words)
            path = pick(4, PATHS).format(n=int(draw[6]) % 10_000, w=word)
            rows.append((pick(5, FRONTS) + name + "." + pick(6, ENDS) + path, label))
    if part is None:
        return tuple(rows)
    return tuple(r for i, r in enumerate(rows) if (i % parts == -part - 1) == (part < 0)) if part < 0 else tuple(r for i, r in enumerate(rows) if i % parts != part)


BITS = 16
LENGTHS = (3, 4, 5)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (null if none) and its verdict; a literal chain, so it stays in generated code."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        text, verdict = F.when(fits, F.lit(at + start)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def gram_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every character n-gram; each text is wrapped in a start and an end mark."""
    wrapped = [b"^" + t + b"$" for t in texts]
    flat = np.frombuffer(b"".join(wrapped), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(wrapped)), [len(t) for t in wrapped])
    rows, buckets = [], []
    for n in LENGTHS:
        if len(flat) < n:
            continue
        many = len(flat) - n + 1
        code = np.full(many, n, np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + flat[k:k + many]
        same = row[:many] == row[n - 1:]
        rows.append(row[:many][same])
        buckets.append((mix64(code[same]) >> np.uint64(64 - BITS)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(buckets)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def url_key(host: str, path: str) -> bytes:
    return f"{host} {path}".encode("utf-8", "surrogatepass")


@lru_cache(maxsize=4)
def train(labelled: Sequence[tuple[str, int]] | None = None, steps: int = 400, rate: float = 4.0, ridge: float = 1e-5) -> np.ndarray:
    """Weights (one per bucket, the intercept last) by full-batch gradient descent on length-normalised n-gram counts."""
    labelled = labelled_table() if labelled is None else labelled
    texts = [url_key(*(u.split("/", 1)[0], "/" + u.split("/", 1)[1] if "/" in u else "")) for u, _ in labelled]
    y = np.array([label for _, label in labelled], float)
    row, bucket = gram_buckets(texts)
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    share = min(max(y.mean(), 1e-9), 1 - 1e-9) if len(y) else 0.5
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / max(len(y), 1)  # both classes count alike
    w = np.zeros((1 << BITS) + 1)
    speed = np.zeros_like(w)
    for _ in range(steps):
        error = (probabilities(row, bucket, scale, w) - y) * weight
        gradient = np.append(np.bincount(bucket, weights=(error * scale)[row], minlength=1 << BITS) + ridge * w[:-1], error.sum())
        speed = 0.9 * speed - rate * gradient
        w += speed
    return w


def probabilities(row, bucket, scale, w) -> np.ndarray:
    z = np.bincount(row, weights=w[bucket], minlength=len(scale)) * scale + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(texts: list[bytes], w: np.ndarray) -> np.ndarray:
    """Probability that each URL should be blocked."""
    row, bucket = gram_buckets(texts)
    return probabilities(row, bucket, 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(texts)), 1)), w)


def judge(pages: DataFrame, url: str = "url", rules=RULES, labelled: Sequence[tuple[str, int]] | DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, block_score and verdict to (page_id, url).

    A null URL or one without ``://`` has an empty host and path, fits no rule and is judged by the model like any other.
    Repeated rows are judged alike, very long URLs whole; an empty table gives no rows; columns other than ``page_id`` and the URL are not read.
    ``labelled`` has pairs (host and path, 1 to block), or is a table (url, label) of at most ``MOST_LABELLED`` rows (an error beyond).
    """
    if isinstance(labelled, DataFrame):
        known = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull()).select(F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("u"), F.col("label").cast("int").alias("y"))
        labelled = sorted((r["u"], r["y"]) for r in small_rows(known, MOST_LABELLED, "labelled URLs"))
    weights = train(tuple(labelled) if labelled is not None else None)
    parts = pages.select("page_id", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, block_score double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                texts = [h + b" " + p for h, p in zip(byte_texts(part.column("host")), byte_texts(part.column("path")))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score(texts, weights))], ["page_id", "host", "path", "block_score"])

    return (parts.mapInArrow(scored, schema)
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, F.when(F.col("block_score") >= threshold, "block").otherwise("allow")).alias("verdict"), "block_score"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """Judge the URL of every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
