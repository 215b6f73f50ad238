"""Building a labelled image set: store results, label geometry, generated lines, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bundle_name
from ..schemas import STORE_RESULTS

# Class numbers, an image's size, and the grid of a seed phrase.
ENV_EDITOR, TERMINAL, SEED = 3, 4, 1
WIDTH, HEIGHT = 1280, 720
GRID_X, GRID_Y, CELL_W, CELL_H, COLUMNS, ROWS = 280, 200, 240, 70, 3, 4


def pick_app(results: Column, prefix: Column) -> Column:
    """The first result whose bundle starts with the prefix, else the first, else null."""
    fits = F.filter(results, lambda r: F.startswith(F.coalesce(r["bundleId"], F.lit("")), prefix))
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.try_element_at(results, F.lit(1)))


def screenshots(app: Column) -> Column:
    """Telephone screenshots, then tablet ones."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(app["screenshotUrls"], none), F.coalesce(app["ipadScreenshotUrls"], none))


def store_screenshots(searches: DataFrame) -> DataFrame:
    """(term, prefix, body: a search reply as JSON) -> a row for each screenshot with its file name."""
    app = pick_app(F.from_json("body", STORE_RESULTS)["results"], F.col("prefix"))
    d = searches.select("term", app.alias("app")).where("app is not null")
    d = d.select("term", bundle_name(F.col("app.bundleId")).alias("bundle"), F.coalesce("app.trackName", F.lit("unknown")).alias("name"), F.posexplode(screenshots(F.col("app"))).alias("i", "url"))
    return d.select("term", "bundle", "name", "url", F.format_string("%s/%02d.png", "bundle", "i").alias("path"))


def editor_label(bottom: Column, top: int = 50) -> Column:
    """Normalised box of an editor's text from ``top`` to ``bottom``."""
    return _label(ENV_EDITOR, F.lit((20 + 800) / 2 / WIDTH), (F.lit(top) + bottom) / 2 / HEIGHT, F.lit(800 / WIDTH), (bottom - top) / HEIGHT)


def terminal_label(bottom: Column, top: int = 20) -> Column:
    return _label(TERMINAL, F.lit(0.5), (F.lit(top) + bottom) / 2 / HEIGHT, F.lit((WIDTH - 20) / WIDTH), (bottom - top + 20) / HEIGHT)


def seed_label() -> Column:
    return _label(SEED, F.lit((GRID_X + 3 * CELL_W / 2) / WIDTH), F.lit((GRID_Y + 2 * CELL_H) / HEIGHT), F.lit((3 * CELL_W + 20) / WIDTH), F.lit((4 * CELL_H + 20) / HEIGHT))


def _label(number: int, xc: Column, yc: Column, w: Column, h: Column) -> Column:
    return F.struct(F.lit(number).alias("class"), *[v.cast("double").alias(n) for n, v in (("xc", xc), ("yc", yc), ("w", w), ("h", h))])


def label_line(label: Column) -> Column:
    """Six decimals, a half to the even one."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", label["class"], *[F.bround(label[c], 6) for c in ("xc", "yc", "w", "h")])


def seed_cells(words: DataFrame) -> DataFrame:
    """(image, words) -> the numbered words with their cells' corners."""
    d = words.select("image", F.posexplode("words").alias("i", "word"))
    return d.select("image", "i", F.format_string("%d. %s", F.col("i") + 1, "word").alias("text"), (F.lit(GRID_X) + F.col("i") % COLUMNS * CELL_W).alias("x"), (F.lit(GRID_Y) + F.floor(F.col("i") / COLUMNS) * CELL_H).alias("y"))


def seed_words(digest: Column, words: tuple[str, ...], n: int = 12) -> Column:
    """n words, repeats allowed, drawn by the hexadecimal digits of a digest."""
    table = F.array(*[F.lit(w) for w in words])
    at = lambda i: F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int") % len(words)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(table, at(i) + 1))


def env_line(digest: Column, which: Column) -> Column:
    """A made-up line of an environment file: one of nine kinds, its secret from a digest of 64 hexadecimal digits."""
    d = F.concat(digest, digest)
    name = F.element_at(F.array(*[F.lit(x) for x in ("API_KEY", "SECRET_KEY", "AUTH_TOKEN", "SESSION_SECRET", "ENCRYPTION_KEY", "WEBHOOK_SECRET", "CLIENT_SECRET")]), (F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % 7 + 1))
    kinds = [
        F.concat(F.lit("AWS_ACCESS_KEY_ID=AKIA"), F.upper(F.substring(d, 1, 16))),
        F.concat(F.lit("GH_TOKEN=ghp_"), F.substring(d, 1, 36)),
        F.concat(F.lit("STRIPE_SECRET=sk_live_"), F.substring(d, 1, 24)),
        F.concat(F.lit("OPENAI_API_KEY=sk-"), F.substring(d, 1, 48)),
        F.concat(F.lit("ANTHROPIC_API_KEY=sk-ant-api03-"), F.substring(d, 1, 95), F.lit("-aaaaaaaa")),
        F.concat(F.lit("DATABASE_URL=postgresql://"), F.substring(d, 1, 8), F.lit(":"), F.substring(d, 9, 16), F.lit("@db.example.com:5432/app")),
        F.concat(F.lit("JWT_SECRET=eyJ"), F.substring(d, 1, 20), F.lit(".eyJ"), F.substring(d, 21, 20), F.lit("."), F.substring(d, 41, 30)),
        F.concat(F.lit("TWILIO_SID=AC"), F.substring(d, 1, 32)),
        F.concat(name, F.lit("="), F.substring(d, 1, 40)),
    ]
    return F.element_at(F.array(*kinds), (which % len(kinds) + 1).cast("int"))


def validation_split(images: DataFrame, labels: DataFrame, there: DataFrame, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """(stem) of images that move to validation: a seeded share, with a label, not there already.

    The order is by a hash of name and seed. It is cut by rank from counts over narrow
    ranges of the hash, so only the range that holds the cut is sorted.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must be from 0 to 1")
    d = images.select("stem", F.md5(F.concat("stem", F.lit(f":{seed}")).cast("binary")).alias("o")).withColumn("range", F.substring("o", 1, 3))
    from pyspark.sql import Window as W

    want = F.floor(F.sum("n").over(W.partitionBy()) * fraction)
    counts = d.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), want.alias("want"))
    first = d.join(counts, "range").where("before < want").withColumn("place", F.col("before") + F.row_number().over(W.partitionBy("range").orderBy("o", "stem")))
    return first.where("place <= want").select("stem").join(labels.select("stem"), "stem", "left_semi").join(there.select("stem"), "stem", "left_anti")


def class_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("class").agg(F.count("*").alias("n"))
