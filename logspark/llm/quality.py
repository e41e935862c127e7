"""Document quality by hierarchical empirical Bayes.

A logistic regression on layout features of the text gives each document its own
evidence. The evidence is summed by host and by path below a host in one grouped
aggregation. Host means are shrunk towards the global mean, path means towards their
host's, by the strength that the spread between hosts shows: a sparse site falls
back on what is known above it. A document's log odds are its own plus those by
which its path differs from the global mean.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.shared import fresh, land

#: Labelled rows that the regression is fitted on, those with the smallest hashes of their ids.
MAX_LABELLED = 20_000
#: Documents below this probability are rejected.
THRESHOLD = 0.5
#: Bounds of the shrinking strength, in documents.
STRENGTH = (1.0, 10_000.0)
SEED = 42


def features(text: Column) -> dict[str, Column]:
    """Layout features of a text; the shares are of its words or characters."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.greatest(F.regexp_count(text, F.lit(r"\S++")), F.lit(1)).cast("double")
    capped = lambda share: F.least(share, F.lit(1.0))
    return {
        "log_words": F.log1p(words) / 10,
        "upper": F.regexp_count(text, F.lit(r"\p{Lu}")) / chars,
        "bars": capped((F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))) / words),
        "exclaimed": capped(F.regexp_count(text, F.lit("!!+")) / words),
        "symbols": capped(F.regexp_count(text, F.lit(r"[%&$#*^~=<>{}\\|@_]{2,}+")) / words),
        "repeated": capped(F.regexp_count(text, F.lit(r"(?<!\S)(\S++)(?=\s++\1(?!\S))")) / words),
        "letters": F.regexp_count(text, F.lit(r"\p{L}++")) / words / 2,
        "no_text": F.when(F.trim(text) == "", 1.0).otherwise(0.0),
    }


def fit_evidence(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> tuple[float, dict[str, float]]:
    """Intercept and weights of the regression; all zero where there are not two classes."""
    chosen = (labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("label"))
              .where("label_id IS NOT NULL AND label IN (0, 1)")
              .orderBy(F.xxhash64("label_id", F.lit(SEED)), "label").limit(max_labelled))
    chosen = land(chosen, "quality-labels")  # at most max_labelled short rows, hence the broadcast
    named = features(F.col("text"))
    rows = (docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"))
            .join(F.broadcast(chosen), "label_id")
            .select("label", *[c.cast("double").alias(k) for k, c in named.items()]))
    rows = land(rows.orderBy(F.hash(*named)).limit(2 * max_labelled), "quality-rows")
    if rows.select("label").distinct().count() < 2:
        return 0.0, dict.fromkeys(named, 0.0)
    data = VectorAssembler(inputCols=list(named), outputCol="features").transform(rows)
    model = LogisticRegression(regParam=1e-4, maxIter=50).fit(data)
    return float(model.intercept), dict(zip(named, map(float, model.coefficients), strict=True))


def evidence(text: Column, model: tuple[float, dict[str, float]]) -> Column:
    """Log odds of good quality by the text alone.

    Never null, so that no filter on a score makes the optimizer test the features for
    null below the join, which would compute them once more.
    """
    intercept, weights = model
    return F.coalesce(F.lit(intercept) + sum(F.lit(weights[k]) * c for k, c in features(text).items()), F.lit(0.0))


def _chance(log_odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))


def _log_odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.ln(p / (F.lit(1.0) - p))


def site_columns(source: Column, section: Column) -> tuple[Column, Column]:
    """Host and path of a document: the source up to its first slash, and what follows it.

    A source without a path is split by ``section`` instead, here the language.
    """
    source = F.coalesce(source.cast("string"), F.lit(""))
    rest = F.regexp_extract(source, r"^[^/]*+/([^/]++)", 1)
    return F.substring_index(source, "/", 1), F.when(rest != "", rest).otherwise(F.coalesce(section.cast("string"), F.lit("")))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, host_mean, path_mean, global_mean) from rows (host, path, p)."""
    paths = land(scored.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("s"),
                                                    F.sum(F.col("p") * (1 - F.col("p"))).alias("v")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("v").alias("host_v"))
    hosts = land(hosts, "quality-hosts")
    total = hosts.agg(F.sum("host_s").alias("s"), F.sum("host_n").alias("n")).first()
    mean = (total.s or 0.0) / (total.n or 1.0)
    site = F.col("host_s") / F.col("host_n")
    spread = hosts.agg(F.avg(F.pow(site - F.lit(mean), F.lit(2.0))).alias("seen"),
                       F.avg(F.col("host_v") / F.pow("host_n", F.lit(2.0))).alias("noise")).first()
    between = (spread.seen or 0.0) - (spread.noise or 0.0)
    strength = max(STRENGTH[0], min(STRENGTH[1], mean * (1 - mean) / between - 1)) if between > 0 else STRENGTH[1]
    shrunk = lambda s, n, up: (F.col(s) + F.lit(strength) * up) / (F.col(n) + F.lit(strength))
    hosts = hosts.withColumn("host_mean", shrunk("host_s", "host_n", F.lit(mean)))
    return paths.join(hosts, "host").select(
        "host", "path", "host_mean", shrunk("s", "n", F.col("host_mean")).alias("path_mean"),
        F.lit(mean).alias("global_mean"))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source", section_col: str = "lang", label_col: str = "quality",
                  threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all) with evidence_p, host_mean, path_mean, quality_p and keep, under names of their own.

    The added names are those of :func:`added`. The features of a text are computed
    once: its evidence is landed beside ``columns``, and both the sites' sums and the
    scores are made from that. Null and empty texts are scored as texts without words,
    null sources and sections as empty ones. Repeated rows are scored alike; ids are
    only used to find labels. Without labels of both classes nothing is rejected.
    """
    model = fit_evidence(docs, labels, id_col, text_col, label_col, max_labelled)
    columns = list(docs.columns) if columns is None else columns
    names = added(docs)
    e, host, path, h, p, g = fresh(
        docs, "quality_e", "quality_host", "quality_path", "quality_h", "quality_s", "quality_global")
    at_host, at_path = site_columns(F.col(source_col), F.col(section_col))
    own = land(docs.select(*[F.col(f"`{c}`") for c in columns], evidence(F.col(text_col), model).alias(e),
                           at_host.alias(host), at_path.alias(path)), "quality-evidence")
    sites = land(site_posteriors(own.select(F.col(host).alias("host"), F.col(path).alias("path"), _chance(F.col(e)).alias("p"))),
                 "quality-sites").toDF(h, p, names[1], names[2], g)
    scored = own.join(sites, (F.col(host) == F.col(h)) & (F.col(path) == F.col(p)), "left")
    odds = F.col(e) + _log_odds(F.col(names[2])) - _log_odds(F.col(g))
    fitted = any(model[1].values())
    scored = scored.withColumns({names[0]: _chance(F.col(e)), names[3]: _chance(odds)})
    keep = F.col(names[3]) >= threshold if fitted else F.lit(True)
    return scored.select(*[F.col(f"`{c}`") for c in columns], *names[:4], keep.alias(names[4]))


def added(docs: DataFrame) -> list[str]:
    """The names under which :func:`score_quality` adds its columns."""
    return fresh(docs, "evidence_p", "host_mean", "path_mean", "quality_p", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with the columns of ``docs``."""
    return score_quality(docs, labels, **options).where(F.col(added(docs)[4])).select(*[f"`{c}`" for c in docs.columns])
