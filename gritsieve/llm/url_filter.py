"""Operator 4: URL filters by logistic regression on hashed character n-grams of host and path.

Host and path are cut from the URL inside the JVM and folded to ASCII lower case. Hashed byte 3-, 4- and 5-grams of each,
with marks at both ends, have buckets of their own; a URL is the vector of their counts at a fixed length. The model is
trained on a small labelled URL table (by default :data:`LABELLED`, of some 2,500 rows; a table given is used whole up to
``ROWS`` distinct rows in hash order, the documented bound) and calibrated on a held-out fifth. The threshold is fixed.

Scale: a map over the rows, no shuffle; only the URL column is read. Defined cases: a null, blank or unparsable URL has no
score and isn't blocked; very long URLs are scored whole; equal URLs score equally; repeated rows stay; null ids stay null;
an empty table gives an empty result; without labels of both classes nothing is scored; further columns are ignored by
:func:`scores` and kept by :func:`keep_allowed`.
"""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .logreg import Model, Rows, train
from .textkernel import chunks, need

_U = np.uint64
DIM = 1 << 18
ROWS = 20_000
BLOCK_FROM = 0.5
#: The share of blocked URLs that calibration assumes.
PRIOR = 0.2
_SCALE = 3.0
_L2 = 3e-4

#: Labelled hosts and paths, by hand: what the sites of a kind call themselves. One line is one kind of site.
_BAD = """
casino slots roulette blackjack jackpot gambling freespins spinwin | /play/slots /casino/bonus /spin /deposit
poker pokies betting bookmaker sportsbet oddsbet bingo lotto lottery wagers | /bet/now /odds/live /jackpot
porn porno xxx sexcam sexchat nude nudes milf hentai camgirls adultvideo | /video/xxx /cam/live /gallery/nude
escort escorts hookup fling sexdating adultdating erotik erotica | /girls/city /meet/tonight
viagra cialis pharmacy-rx pillstore cheapmeds steroids tramadol painpills | /buy/pills /order/no-prescription
payday quickloan cashadvance fastcash getrich earnmoney forexprofit binaryoptions | /apply/instant /signup?aff=9
adserver adclick adnetwork popads popunder doubleads bannerads admedia | /click?cid=1 /serve/banner /imp.gif
tracker pixeltrack trackclick clickstats affiliatelink affclick redirads | /track?pixel=7 /r?aff=3 /go/offer
warez keygen crackz cracked serialz nulled torrents freemovies camrip | /download/crack /torrent/123
malware phish verify-account account-update login-secure freegift winprize claimprize | /verify/login.php /claim /gift/free
replica fakewatch cheapbags knockoff outletsale discountjersey | /sale/replica /cheap/bags
linkfarm seolinks buybacklinks bulkmail spamlist clickbait viralnow | /links/buy /10-shocking-tricks
"""
_GOOD = """
library archive museum gallery heritage history folklore | /collections/maps /exhibitions/2019 /opening-hours
university college academy school campus faculty institute kindergarten | /courses/physics /staff/list /admissions
hospital clinic surgery dentist nursing health wellbeing pharmacist | /departments/heart /visiting /flu-season
parliament council townhall ministry court police embassy election census | /minutes/may /forms/passport /notices
newspaper gazette herald tribune chronicle journal observer bulletin radio | /politics/budget /opinion/letters /weather
weather climate ocean river mountain forest geology volcano glacier island | /forecast/week /field-notes /maps/relief
garden orchard seeds botanic birds beekeeping wildlife farm dairy vineyard | /guides/pruning /species/heron
recipes kitchen baking bread cheese teahouse restaurant brewery market grocer | /soups/lentil /menu /baking/rye
football cricket rowing cycling hockey marathon athletics chess climbing sailing | /fixtures /results/2021 /clubs
orchestra opera choir jazz guitar theatre cinema ballet poetry novels writers | /season /reviews/novel /programme
software developer compiler database python linux kernel opensource manual docs | /docs/install /releases/2.4 /api/index
mathematics physics chemistry biology astronomy statistics economics philosophy | /papers/abstract /lectures/3
railway airport harbour ferry timetable bridge tunnel transport cyclepath | /timetable/sunday /tickets /stations/north
carpentry plumbing joinery architect builder masonry pottery weaving tailor | /projects/stairs /contact /gallery/oak
bank insurance accounting pension treasury mortgage auditor stockholm | /branches /rates /annual-report
church chapel temple mosque synagogue parish charity volunteers refuge | /services/sunday /donate /newsletter
bibliothek schule stadt zeitung garten wetter verein musik rathaus geschichte | /oeffnungszeiten /artikel/herbst
mairie ecole musee jardin cuisine voyage presse santé theatre histoire | /horaires /articles/printemps
ayuntamiento escuela museo cocina viajes periodico historia deportes musica | /noticias/local /horario
"""
_JOINED = "house online world club city shop plus today north blue green best top my the web new old hill park street line room land".split()


def _labelled() -> list[tuple[str, int]]:
    """Hosts of every kind of site alone, joined to common words and to others of the kind; and hosts that say nothing, which are allowed."""
    out = []
    ends = itertools.cycle(["com", "org", "net", "info", "co.uk", "de", "fr", "es", "example.com", "example.org", "example.net"])
    heads = itertools.cycle(["www.", "", "en.", "m.", "shop.", "my.", "blog.", "", "news."])
    plain = itertools.cycle(["", "/", "/index.html", "/page/4", "/a/b/c", "/2018/11/03/", "/item?id=1880", "/search?q=x#r2"])
    rng = random.Random(1)
    for kinds, label in ((_BAD, 1), (_GOOD, 0)):
        for line in kinds.strip().splitlines():
            names, paths = (part.split() for part in line.split("|"))
            for name in names:
                for host in (name, name, name + rng.choice(_JOINED), rng.choice(_JOINED) + name, f"{rng.choice(_JOINED)}-{name}", f"{name}-{rng.choice(names)}", name + rng.choice(names), f"{name}{rng.randint(1, 99)}"):
                    out.append((f"https://{next(heads)}{host}.{next(ends)}{rng.choice(paths) if rng.random() < 0.5 else next(plain)}", label))
    for word in _JOINED:
        out += [(f"http://{next(heads)}{word}{other}.{next(ends)}{next(plain)}", 0) for other in rng.sample(_JOINED, 6)]
    for _ in range(500):  # what is unknown isn't suspect
        name = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 14)))
        out.append((f"https://{next(heads)}{name}.{next(ends)}{next(plain)}", 0))
    return out


#: (url, 1 for blocked) rows; made from the lists above, not taken from any corpus.
LABELLED = _labelled()


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path with query and fragment), folded; null for what isn't a URL with a host."""
    pattern = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:@\s]+)(?::\d*)?([/?#][\s\S]*)?$"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.translate(F.regexp_extract(url, pattern, 2), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(host != "", host), F.when(host != "", path)


def _buckets(column: pa.Array, salt: int):
    """(bucket of every gram, first and end gram of every row), for runs of rows and each n, with ^ and $ around the text."""
    import pyarrow.compute as pc

    marked = pc.binary_join_element_wise("^", pc.fill_null(column.cast(pa.string()), ""), "$", "")
    for start, end, data, off in chunks(marked):
        wide = data.astype(np.uint64)
        grams = []
        for n in (3, 4, 5):
            if len(data) >= n:
                code = wide[: len(data) - n + 1].copy()
                for j in range(1, n):
                    code |= wide[j : len(data) - n + 1 + j] << _U(8 * j)
                with np.errstate(over="ignore"):
                    bucket = ((code + _U(salt * 131 + n)) * _U(0x9E3779B97F4A7C15)) >> _U(64 - 18)
                grams.append((bucket.astype(np.int64), off[:-1], np.maximum(off[1:] - n + 1, off[:-1])))
        yield start, end, grams


def features(host: pa.Array, path: pa.Array) -> Rows:
    """Sparse rows of gram counts, scaled to one length whatever the URL's."""
    keys = [np.zeros(0, np.int64)]
    for salt, column in enumerate((host, path)):
        for start, end, grams in _buckets(column, salt):
            for bucket, first, last in grams:
                have = np.maximum(np.minimum(last, len(bucket)) - first, 0)
                row = np.repeat(np.arange(start, end), have)
                at = np.repeat(first - np.concatenate([[0], np.cumsum(have)[:-1]]), have) + np.arange(have.sum())
                keys.append(row * DIM + bucket[at])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    row = key // DIM
    norm = np.sqrt(np.bincount(row, weights=count.astype(float) ** 2, minlength=len(host)))
    return Rows((key % DIM).astype(np.int32), _SCALE * count / norm[row], np.searchsorted(key, np.arange(len(host) + 1) * DIM))


def linear(host: pa.Array, path: pa.Array, weights: np.ndarray) -> np.ndarray:
    return features(host, path).dot(weights)


def fit_model(spark: SparkSession, labelled: DataFrame | None = None, rows: int = ROWS) -> Model | None:
    """The calibrated model of a (url, blocked) table, or None if it lacks a class."""
    table = spark.createDataFrame(LABELLED, "url string, blocked int") if labelled is None else need(labelled, "url", "blocked")
    host, path = parts(F.col("url"))
    agreed = table.where(F.col("blocked").isin(0, 1)).select(host.alias("host"), path.alias("path"), F.col("blocked").cast("int").alias("y")).where("host is not null")
    agreed = agreed.groupBy("host", "path").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most")
    got = agreed.select("host", "path", "y", F.xxhash64("host", "path").alias("order")).orderBy("order", "host", "path").limit(rows).toArrow().combine_chunks()
    y = got["y"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return None
    x = features(got["host"].combine_chunks(), got["path"].combine_chunks())
    fold = np.array(got["order"].to_numpy()).view(np.uint64) % _U(5)
    return train(x, y, np.where(y > 0, PRIOR * len(y) / y.sum(), (1 - PRIOR) * len(y) / (len(y) - y.sum())), DIM, fold == 0, _L2)


def probability(model: Model | None, url: Column) -> Column:
    """Probability that the URL belongs to a blocked class; null for no URL."""
    if model is None:
        return F.lit(None).cast("double")

    @F.arrow_udf("double")
    def score(host: pa.Array, path: pa.Array) -> pa.Array:
        p = model.probability(linear(host, path, model.weights))
        return pa.array(p, mask=host.is_null().to_numpy(zero_copy_only=False))

    return score(*parts(url))


def scores(pages: DataFrame, model: Model | None) -> DataFrame:
    """(page_id, url, blocked_p, blocked) of every row."""
    out = need(pages, "page_id", "url").withColumn("blocked_p", probability(model, F.col("url")))
    return out.withColumn("blocked", F.coalesce(F.col("blocked_p") >= BLOCK_FROM, F.lit(False)))


def keep_allowed(pages: DataFrame, model: Model | None) -> DataFrame:
    """``pages``, all columns, without blocked URLs."""
    names = pages.columns
    new = "_blocked"
    while new in {n.lower() for n in names}:
        new += "_"
    scored = pages.withColumn(new, probability(model, F.col("`url`")))
    return scored.where(~F.coalesce(F.col(new) >= BLOCK_FROM, F.lit(False))).select(*[F.col(f"`{n}`") for n in names])


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/pages.parquet"), fit_model(spark))
