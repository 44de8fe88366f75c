"""Line dedup: lines that a large share of a site's pages carry are boilerplate."""

from pyspark.sql import DataFrame, functions as F

#: well below the rates of real boilerplate; from 0.7 % down, lines that only copies of one page share come in
RATIO = 0.01
MIN_PAGES = 3


def boilerplate_lines(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Lines found on more than ``ratio`` of their host's pages: host, line, pages, host_pages.

    A line is compared without the blanks around it; blank lines are never boilerplate. A page
    counts once for a line however often it repeats it, and a page with a null text counts in
    the total. Below ``min_pages`` pages no line is boilerplate, so small hosts keep theirs.
    Both counts combine on the map side, so a host with a third of all pages moves no more
    than one row per task and distinct line. The null host is a host.
    """
    pages = docs.select(F.col(host).alias("host"), _lines("text").alias("lines"))
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    counted = (
        pages.select("host", F.explode(F.array_distinct(F.transform("lines", F.trim))).alias("line"))
        .where("line <> ''")
        .groupBy("host", "line")
        .agg(F.count("*").alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    totals = totals.withColumnRenamed("host", "total_host")
    return (
        counted.join(totals, F.col("host").eqNullSafe(F.col("total_host")))
        .where(F.col("pages") > F.lit(ratio) * F.col("host_pages"))
        .select("host", "line", "pages", "host_pages")
    )


def line_dedup(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` without boilerplate lines, plus n_lines and n_dropped; every row and column stays.

    Kept lines keep their order and blanks and are joined by line feeds as before. A document
    all of whose lines go has an empty text; a null text stays null with 0 lines, an empty
    text has one line. Columns of ``docs`` called n_lines or n_dropped are replaced. Repeated
    rows are pages of their own.

    The lines a host drops travel as one array per host. Since each is on more than ``ratio``
    of the host's pages, there are fewer than (mean distinct lines per page) / ``ratio`` of
    them, however large the host is. The join by host sends each document once at most, and
    adaptive execution splits the documents of a very large host.
    """
    dropped = (
        boilerplate_lines(docs, host, ratio, min_pages).groupBy("host").agg(F.collect_list("line").alias("__drop"))
        .withColumnRenamed("host", "__host")
    )
    joined = docs.join(dropped, docs[host].eqNullSafe(F.col("__host")), "left")
    none = F.array().cast("array<string>")
    bad = F.coalesce("__drop", none)
    lines = _lines("text")
    kept = F.filter(lines, lambda line: ~F.array_contains(bad, F.trim(line)))
    joined = joined.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_dropped")],
        F.col("text").alias("__text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
        F.when(F.col("__drop").isNotNull(), kept).alias("__kept"),
    )
    whole = F.col("__text")
    out = {
        "text": F.when(whole.isNull() | F.col("__kept").isNull(), whole).otherwise(F.array_join("__kept", "\n")),
        "n_dropped": F.when(whole.isNull() | F.col("__kept").isNull(), F.lit(0).cast("bigint")).otherwise(
            F.col("n_lines") - F.size("__kept")
        ),
    }
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *[out["text"].alias("text") if c == "text" else F.col(f"`{c}`") for c in rest],
        F.when(whole.isNull(), F.lit(0).cast("bigint")).otherwise(F.col("n_lines")).alias("n_lines"),
        out["n_dropped"].alias("n_dropped"),
    )


def _lines(text: str):
    """The lines of a text; of a null text none."""
    return F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>"))
