"""URL filters: rules by host and path, and for the rest a classifier over segmented words.

Host labels and path parts are cut at what is not a letter; each run of letters is segmented by Viterbi under a unigram model, and
a multinomial naive Bayes model scores the words. The unigram model's words are those of the corpus' texts, with their counts, over a
general list of English words (the tokenizer's, by rank) and their plurals; words that stand alone in the URLs judged count too, but
a URL alone makes no word, as then every run would be one. The MOST_WORDS most frequent of these words are known, of equal counts the
first by code points; they are the same for all URLs of a run, so a verdict depends on its own row and the corpus. Unknown runs get a
probability that falls with their length, so they stay whole. The classifier is trained on the labelled examples below, or on those
that the caller gives; words that it never saw say nothing, and a score of 0 or less is no block.

Null URLs and those without `://` have an empty host and path, match no rule and are allowed. Repeated URLs are judged alike, each
row for itself. Very long URLs are judged whole, in time that grows with their length. An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .token_counts import tokenizer_path

#: Labelled examples, words apart: what each class is trained on.
BLOCKED = (
    "online casino bonus", "casino slots jackpot", "poker casino", "casino roulette", "best bets", "sports bets odds", "betting tips", "betting odds", "bet cash", "gambling slots",
    "online gambling", "gambling bonus", "lottery jackpot", "lottery numbers", "win lottery", "bingo jackpot", "viagra pills", "viagra online", "cialis pills discount", "pills pharmacy online",
    "diet pills", "weight loss pills", "weight loss miracle", "lose weight fast", "miracle cure", "steroids online", "adult videos", "adult cams", "xxx videos", "xxx adult", "porn tube", "porn videos",
    "sex cams", "sex videos", "nude cams live", "nude girls", "escort girls", "spam links", "link spam", "seo spam", "spam mail", "buy followers", "ads click", "ads network", "ads banner", "popup ads",
    "casino games", "live casino", "mobile casino", "casino royal", "vegas casino", "free spins casino", "free slots", "free spins", "free porn", "free sex videos", "free cams", "free viagra",
    "casino gambling", "gambling games", "sports gambling", "gambling affiliate", "lottery winner", "lottery tickets", "mega lottery", "lottery results online", "football bets", "live bets", "sure bets", "bets today",
    "weight loss", "rapid weight loss", "weight loss diet", "weight loss tea", "keto weight loss", "cheap cialis", "cheap replica", "cheap steroids", "buy viagra", "viagra pharmacy", "buy pills", "sleeping pills online",
    "ads server", "ads tracking", "ads popunder", "banner ads", "ads media", "spam bot", "spam blast", "email spam", "spam host", "adult dating", "adult chat", "adult movies", "adult toys", "adult tube", "xxx porn", "hot porn",
    "tracker pixel", "click tracker", "malware download", "virus download", "phishing login", "warez crack keygen", "torrent crack", "serial keygen", "replica watches cheap", "cheap viagra", "payday loans fast", "loans cash", "earn cash fast",
)
ALLOWED = (
    "news today", "daily news", "science journal", "university research", "public library", "city council", "health clinic", "weather report", "garden shop", "book store", "music school",
    "travel guide", "recipes kitchen", "open source code", "python docs", "history museum", "art gallery", "sports club", "football results", "free software", "free encyclopedia", "online course",
    "online shop", "live weather", "photo album", "family photos", "technology review", "government service", "local business", "farm market", "family farm", "race track results", "bank account",
    "cash flow", "login page", "adult education", "adult learning", "education online", "higher education", "hair loss clinic", "birth weight", "cheap flights", "cheap hotels", "home loans", "student loans",
    "girls school", "boys school", "video tutorial", "music videos", "mail server", "download docs", "links page", "followers", "watches shop", "fast food", "pharmacy school", "cure research", "lost and found",
)
#: Letters of the longest word that is looked for in a run. What the general list counts in all is about 11 times GENERAL.
LONGEST, GENERAL = 24, 1_000_000
#: Words that the unigram model knows at most: what the driver holds and each task gets.
MOST_WORDS = 300_000
#: Share of the classes before any word is seen.
PRIOR_BLOCKED = 0.25
#: (rule, verdict): a host and a path; a rule holds for the host and its subdomains where the path starts with the rule's.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = "://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        of, start = text.split("/", 1)
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


@lru_cache(1)
def general_words() -> dict[str, int]:
    """Counts by Zipf's law of the tokenizer's words, of 3 letters on, and of their plurals at a tenth."""
    with open(tokenizer_path("byte_bpe_50k.json")) as f:
        ranks = json.load(f)["model"]["vocab"]
    out: dict[str, int] = {}
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if re.fullmatch("\u0120[A-Za-z]{3,}", token):
            out.setdefault(token[1:].lower(), GENERAL // (rank + 1) + 1)
    return {f"{w}s": n // 10 + 1 for w, n in out.items() if len(w) > 3} | out


class Words:
    """The unigram model and the classifier. seen: counts of words of the corpus."""

    def __init__(self, seen: dict[str, int] | None = None, blocked=BLOCKED, allowed=ALLOWED) -> None:
        bad, good = (Counter(w for x in part for w in x.split()) for part in (blocked, allowed))
        prior = bad + good
        self.counts = dict(general_words())
        for w, n in [*((w, n * 100) for w, n in prior.items()), *(seen or {}).items()]:
            self.counts[w] = self.counts.get(w, 0) + n
        self.total = sum(self.counts.values())
        vocabulary = len(prior)
        n_bad, n_good = sum(bad.values()), sum(good.values())
        self.odds = {w: math.log((bad[w] + 1) / (n_bad + vocabulary)) - math.log((good[w] + 1) / (n_good + vocabulary)) for w in prior}
        self.start = math.log(PRIOR_BLOCKED / (1 - PRIOR_BLOCKED))
        self.longest = LONGEST
        self.segment = lru_cache(100_000)(self._segment)

    def _cost(self, word: str) -> float:
        n = self.counts.get(word)
        if n and len(word) > 2:
            return -math.log(n / self.total)
        return math.log(self.total) + len(word) * math.log(10)

    def _segment(self, run: str) -> tuple[str, ...]:
        """The cheapest words; an unknown piece may have any length. Of equal costs the one with the later last cut."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        last_unknown = math.inf  # the least of cost before an unknown piece, free of its length
        unknown_from = 0
        for end in range(1, len(run) + 1):
            cost = best[end - 1][0] - (end - 1) * math.log(10)
            if cost < last_unknown:
                last_unknown, unknown_from = cost, end - 1
            options = [(last_unknown + math.log(self.total) + end * math.log(10), unknown_from)]
            for at in range(max(0, end - self.longest), end - 2):
                if run[at:end] in self.counts:
                    options.append((best[at][0] + self._cost(run[at:end]), at))
            best.append(min(options, key=lambda o: (o[0], -o[1])))
        out, end = [], len(run)
        while end:
            out.append(run[best[end][1] : end])
            end = best[end][1]
        return tuple(reversed(out))

    def words(self, host: str, path: str) -> list[str]:
        runs = re.findall(r"[^\W\d_]+", f"{host} {path.lower()}")
        return [w for r in runs for w in self.segment(r)]

    def score(self, host: str, path: str) -> float:
        """Log odds of block against allow."""
        return self.start + sum(self.odds.get(w, 0.0) for w in self.words(host, path))


def lexicon_counts(urls: DataFrame, texts: DataFrame | None) -> dict[str, int]:
    """How often the words that occur in some run of the URLs stand alone in texts (one column) and URLs. All words of the texts are
    counted; those found inside no run of a URL can't change a segmentation and aren't collected."""
    spark = urls.sparkSession
    letters = lambda c: F.explode(F.split(F.lower(c), r"[^\p{L}]+")).alias("w")
    runs = urls.select(letters(F.concat_ws("/", "host", "path"))).where(F.length("w") > 2).groupBy("w").agg(F.count(F.lit(1)).alias("alone"))
    at = runs.select("w", F.explode(F.sequence(F.lit(1), F.length("w") - 2)).alias("i"))
    inside = at.select(F.explode(F.expr(f"transform(sequence(3, least({LONGEST}, length(w) - i + 1)), n -> substring(w, i, n))")).alias("w")).distinct()
    words = spark.createDataFrame([(w, 0) for w in sorted({*general_words(), *(w for x in BLOCKED + ALLOWED for w in x.split())})], "w string, n int")
    if texts is not None:
        words = words.unionAll(texts.select(letters(F.col(texts.columns[0]))).select("w", F.lit(1).alias("n")))
    counts = words.where(F.length("w").between(3, LONGEST)).groupBy("w").agg(F.sum("n").alias("n")).join(inside, "w", "left_semi").join(runs, "w", "left")
    found = counts.select("w", (F.col("n") + F.coalesce("alone", F.lit(0))).alias("n")).where("n > 0").orderBy(F.desc("n"), "w").limit(MOST_WORDS)
    return {r["w"]: r["n"] for r in found.collect()}


def judge(pages: DataFrame, texts: DataFrame | None = None, *, blocked=BLOCKED, allowed=ALLOWED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; texts: the corpus, one column; blocked and allowed: the examples."""
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    shared = pages.sparkSession.sparkContext.broadcast(lexicon_counts(urls, texts))  # MOST_WORDS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Words(shared.value, blocked, allowed)
        for b in batches:
            score = [model.score(h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
            verdict = [v or ("block" if s > 0 else "allow") for v, s in zip(b.column("verdict").to_pylist(), score)]
            yield pa.record_batch([*(b.column(k) for k in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(score, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

    ruled = urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    kind = dict(urls.dtypes)["page_id"]
    return ruled.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents").select("text"))
