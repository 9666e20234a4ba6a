"""Queries over SVG values, animation, style and page geometry, and over terminal sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pixelloom.functions import svg
from pixelloom.operators import predictors, quantize
from pixelloom.plans.pixel_queries import _PAL_SQL, PALETTE
from pixelloom.plans.registry import query
from pixelloom.sinks import kitty, sixel, terminal
from pixelloom.sources.derived import emb_px, table


def values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def literal(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)


def rows_sql(rows, names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({names})"


CLOCKS = [("2s", 2.0), ("500ms", 0.5), ("1.5m", 90.0), ("1h", 3600.0), ("3", 3.0), (" 4 s ", 4.0), ("-1s", -1.0), ("2sx", None), ("x", None), ("", None), ("0.25MS", 0.00025), ("00:10", None)]


@query("clock_values", "text:string seconds:double", rows_sql(CLOCKS, "text, seconds"))
def clock_values(spark, sf):
    return values(spark, [c[:1] for c in CLOCKS], "text string").withColumn("seconds", svg.clock_seconds(F.col("text")))


REPEATS = [("2", 2.0), ("0.5", 0.5), ("", 1.0), (None, 1.0), ("0", None), ("-1", None), ("x", None), (" Indefinite", -1.0)]


@query("repeat_counts", "text:string count:double", rows_sql(REPEATS, "text, count"))
def repeat_counts(spark, sf):
    """Indefinite shows as -1 here."""
    n = svg.repeat_count(F.col("text"))
    return values(spark, [c[:1] for c in REPEATS], "text string").withColumn("count", F.when(n == float("inf"), -1.0).otherwise(n))


LENGTHS = [("10", 10.0), ("10px", 10.0), ("72pt", 96.0), ("6pc", 96.0), ("1in", 96.0), ("2.54cm", 96.0), ("25.4mm", 96.0), ("50%", 100.0), ("2em", 2.0), (" 1e1 ", 10.0), ("px", None), ("", None)]


@query("lengths", "text:string px:double", rows_sql(LENGTHS, "text, px"))
def lengths(spark, sf):
    return values(spark, [c[:1] for c in LENGTHS], "text string").withColumn("px", F.round(svg.length(F.col("text"), 200.0), 9))


COLORS = [
    ("#f80", "ff8800ff"), ("#f808", "ff880088"), ("#112233", "112233ff"), ("#11223344", "11223344"), ("rgb(1, 2, 3)", "010203ff"), ("rgb(100% 0% 50%)", "ff0080ff"),
    ("rgba(1,2,3,0.5)", "01020380"), ("rgb(1 2 3 / 50%)", "01020380"), ("hsl(120, 100%, 50%)", "00ff00ff"), ("hsla(0.5turn 100% 50% / 0.2)", "00ffff33"), ("hsl(30,50%,40%)", "996633ff"),
    ("Red", "ff0000ff"), ("none", "none"), ("#12", None), ("nocolor", None), ("rgba(300,-5,3,128)", "ff000380"),
]


@query("colors", "text:string rgba:string", rows_sql(COLORS, "text, rgba"))
def colors(spark, sf):
    return values(spark, [c[:1] for c in COLORS], "text string").withColumn("rgba", svg.color(F.col("text")))


_T = "(CAST(event_id % 1000 AS DOUBLE) / 100)"


@query("smil_progress", "event_id progress:double", f"SELECT event_id, CASE WHEN {_T} < 1 THEN NULL WHEN {_T} - 1 < 5 THEN round((({_T} - 1) - floor(({_T} - 1) / 2)*2) / 2, 6) ELSE 1 END AS progress FROM events")
def smil_progress(spark, sf):
    t = (F.col("event_id") % 1000).cast("double") / 100
    return table(spark, sf, "events").select("event_id", F.round(svg.smil_progress(t, F.lit(1.0), F.lit(2.0), F.lit(2.5), F.lit(True)), 6).alias("progress"))


_L = f"({_T} - CAST(0.5 AS DOUBLE))"


@query("css_progress", "event_id progress:double", f"SELECT event_id, round(CASE WHEN {_L} < 0 THEN 0 WHEN {_L} < 5 THEN CASE WHEN CAST(floor({_L} / 2) AS BIGINT) % 2 = 1 THEN 1 - ({_L} - floor({_L} / 2)*2) / 2 ELSE ({_L} - floor({_L} / 2)*2) / 2 END ELSE 0.5 END, 6) AS progress FROM events")
def css_progress(spark, sf):
    t = (F.col("event_id") % 1000).cast("double") / 100
    got = svg.css_progress(t, F.lit(0.5), F.lit(2.0), F.lit(2.5), F.lit("alternate"), F.lit("both"))
    return table(spark, sf, "events").select("event_id", F.round(got, 6).alias("progress"))


STOPS = [(0.1, 0, 250), (0.4, 200, 50), (0.4, 20, 90), (0.9, 255, 0)]


@query("gradient_stops", "method:string event_id v w", "e AS (SELECT event_id, CAST(event_id % 700 AS DOUBLE) / 200 - 1 AS t FROM events), s AS (SELECT 'pad' AS method, event_id, greatest(0.0, least(1.0, t)) AS t FROM e UNION ALL SELECT 'repeat', event_id, t - floor(t) FROM e UNION ALL SELECT 'reflect', event_id, CASE WHEN t - 2*floor(t/2) > 1 THEN 2 - (t - 2*floor(t/2)) ELSE t - 2*floor(t/2) END FROM e), d AS (SELECT method, event_id, CAST(t AS DOUBLE) AS t, CAST(0.1 AS DOUBLE) AS o1, CAST(0.4 AS DOUBLE) AS o2, CAST(0.9 AS DOUBLE) AS o3 FROM s)\n--\nSELECT method, event_id, round(round(CASE WHEN t <= o1 THEN 0 WHEN t <= o2 THEN 200*(t-o1)/(o2-o1) WHEN t < o3 THEN 20 + 235*(t-o2)/(o3-o2) ELSE 255 END, 6)) AS v, round(round(CASE WHEN t <= o1 THEN 250 WHEN t <= o2 THEN 250 - 200*(t-o1)/(o2-o1) WHEN t < o3 THEN 90 - 90*(t-o2)/(o3-o2) ELSE 0 END, 6)) AS w FROM d")
def gradient_stops(spark, sf):
    """Samples between sorted stops, one of them hard, by the three ways to spread."""
    stops = F.array(*(F.struct(F.lit(o).alias("offset"), F.lit(v).alias("v"), F.lit(w).alias("w")) for o, v, w in STOPS))
    t = (F.col("event_id") % 700).cast("double") / 200 - 1
    out = None
    for method in ("pad", "repeat", "reflect"):
        part = table(spark, sf, "events").select(F.lit(method).alias("method"), "event_id", svg.spread(t, method).alias("t"))
        out = part if out is None else out.unionByName(part)
    kept = out.withColumn("stops", stops)
    return kept.select("method", "event_id", *(F.round(F.round(svg.between(F.col("stops"), F.col("t"), lambda s, c=c: s[c]), 6)).alias(c) for c in "vw"))


@query("matrix_product", "event_id x:double y:double", "SELECT event_id, round(2*(3*u + 1*v + 5) + 1*(1*u + 2*v - 4) + 7, 6) AS x, round(-1*(3*u + 1*v + 5) + 3*(1*u + 2*v - 4) - 2, 6) AS y FROM (SELECT event_id, CAST(event_id % 17 AS DOUBLE) AS u, CAST(event_id % 5 AS DOUBLE) AS v FROM events)")
def matrix_product(spark, sf):
    def matrix(*v):
        return F.struct(*(F.lit(float(x)).alias(n) for n, x in zip("abcdef", v)))

    both = table(spark, sf, "events").select("event_id", svg.multiply(matrix(2, -1, 1, 3, 7, -2), matrix(3, 1, 1, 2, 5, -4)).alias("m"))
    x, y = svg.moved(F.col("m"), (F.col("event_id") % 17).cast("double"), (F.col("event_id") % 5).cast("double"))
    return both.select("event_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("css_cascade", "user_id event_type:string winner", "SELECT user_id, event_type, arg_max(event_id, CAST(floor(value) AS BIGINT) % 5 * 1000000000 + event_id) AS winner FROM events GROUP BY user_id, event_type")
def css_cascade(spark, sf):
    """Of rules for an element and property the most specific wins, then the latest."""
    rules = table(spark, sf, "events").withColumn("specificity", F.floor("value").cast("long") % 5)
    first = Window.partitionBy("user_id", "event_type").orderBy(F.desc("specificity"), F.desc("event_id"))
    return rules.withColumn("n", F.row_number().over(first)).where("n = 1").select("user_id", "event_type", F.col("event_id").alias("winner"))


_INK = """i AS (SELECT l_suppkey AS page, l_linenumber*17 % 96 + CAST(l_quantity AS BIGINT) AS y FROM lineitem), c AS (SELECT page, y, count(*) AS n FROM i GROUP BY page, y),
u AS (SELECT page, y, sum(n) OVER (PARTITION BY page ORDER BY y) AS upto, sum(n) OVER (PARTITION BY page) AS total FROM c),
b AS (SELECT page, min(CASE WHEN upto > total // 300 THEN y END) AS low, min(CASE WHEN upto >= total - total // 300 THEN y END) AS high FROM u GROUP BY page)
--
SELECT page, greatest(0, least(low, 32) - 16) AS low, least(191, greatest(high, 159) + 16) AS high FROM b"""


@query("page_trim", "page low high", _INK)
def page_trim(spark, sf):
    """Ink histograms of pages 192 high: bounds that cut sparse edges."""
    ink = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_linenumber") * 17 % 96 + F.col("l_quantity").cast("long")).alias("y"))
    return predictors.ink_trim(ink, "page", "y", 192)


_SIX = _PAL_SQL + """, d AS (SELECT img, x, y, k, (r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb) AS d FROM px, pal), i AS (SELECT img, x, y, arg_min(k, d*1000 + k) AS idx FROM d GROUP BY img, x, y),
c AS (SELECT DISTINCT img, idx FROM i), g AS (SELECT c.img, c.idx, x, (SELECT coalesce(bit_or(1 << CAST(y AS INTEGER)), 0) FROM i WHERE i.img = c.img AND i.idx = c.idx AND i.x = t.x) + 63 AS code FROM c, (VALUES (0), (1), (2), (3)) t(x)),
l AS (SELECT img, idx, string_agg(chr(CAST(code AS INTEGER)), '' ORDER BY x) AS s, count(DISTINCT code) AS n, min(code) AS code FROM g GROUP BY img, idx)
--
SELECT img, '#' || idx || CASE WHEN n = 1 THEN '!4' || chr(CAST(code AS INTEGER)) ELSE s END AS line FROM l"""


@query("sixel_lines", "img line:string", _SIX)
def sixel_lines(spark, sf):
    """Sixel columns of each colour of a band, run-length encoded."""
    lines = sixel.color_lines(quantize.nearest_palette(emb_px(spark, sf), PALETTE), 4)
    return lines.select("img", F.concat(F.lit("#"), F.col("idx").cast("string"), F.col("line")).alias("line"))


@query("kitty_stills", "img n_chars head:string", "SELECT vec_id AS img, 1 + length('f=32,s=4,v=4,c=8,r=2,i=' || vec_id || ',p=1,a=T,q=1,m=0;') + 2 + 88 + 2 + 1 + 0 AS n_chars, 'f=32,s=4,v=4,c=8,r=2,i=' || vec_id || ',p=1,a=T,q=1,m=0;' AS head FROM embeddings".replace("1 + length", "3 + length").replace("+ 2 + 88 + 2 + 1 + 0", "+ 88 + 2 + 1"))
def kitty_stills(spark, sf):
    """Embeddings as images of 64 bytes: one escape sequence each."""
    from pixelloom.plans.codec_queries import pages

    text = kitty.still(pages(spark, sf), columns=8, rows=2, image_id=F.col("img"))
    return text.select("img", F.length("kitty").alias("n_chars"), F.regexp_extract("kitty", "_G([^;]*;)", 1).alias("head"))


@query("kitty_chunks", "doc_id seq n", "b AS (SELECT doc_id, length(base64(encode(text))) AS size FROM documents), k AS (SELECT doc_id, size, unnest(range(1 + greatest(0, CAST(ceil((size - 3800) / 4088.0) AS BIGINT)))) AS seq FROM b)\n--\nSELECT doc_id, seq, CASE WHEN seq = 0 THEN least(size, 3800) ELSE least(4088, size - 3800 - (seq - 1)*4088) END AS n FROM k")
def kitty_chunks(spark, sf):
    """Base64 of every whole text, cut as for a terminal."""
    parts = table(spark, sf, "documents").select("doc_id", F.posexplode(kitty.chunks(F.encode("text", "UTF-8"))).alias("seq", "part"))
    return parts.select("doc_id", "seq", F.length("part").alias("n"))


ENVIRONMENTS = [
    (1, None, None, None, None, None, None, False, False), (2, "1", None, None, None, None, None, True, False), (3, None, "xterm-kitty", None, None, None, None, True, True),
    (4, None, "foot", None, None, None, None, False, True), (5, None, "linux", "id", None, None, None, False, True), (6, None, "linux", None, "220000", None, None, False, True),
    (7, None, "linux", None, "219999x", "5199", None, False, False), (8, None, "linux", None, None, "5200", None, False, True), (9, None, "linux", None, None, None, "iTerm.app", False, True),
]


@query("terminal_detection", "id kitty:boolean sixel:boolean", "SELECT id, kitty, sixel FROM (" + rows_sql(ENVIRONMENTS, "id, a, b, c, d, e, f, kitty, sixel") + ")")
def terminal_detection(spark, sf):
    env = values(spark, [e[:7] for e in ENVIRONMENTS], "id long, win string, term string, wt string, konsole string, vte string, program string")
    return env.select(
        "id",
        terminal.kitty_column(F.col("win"), F.col("term")).alias("kitty"),
        terminal.sixel_column(*(F.col(c) for c in ("wt", "term", "konsole", "vte", "program"))).alias("sixel"),
    )


@query("frame_delays", "event_id shown", "SELECT event_id, CASE WHEN event_id % 50 < 20 THEN 100 ELSE event_id % 50 END AS shown FROM events")
def frame_delays(spark, sf):
    return table(spark, sf, "events").select("event_id", sixel.shown_delay(F.col("event_id") % 50).alias("shown"))
