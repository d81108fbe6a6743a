"""The ordered size-reducing passes. Each takes tables and returns new tables with its counters.

References live twice, as JSON inside the dictionaries and as edges; a pass changes dictionaries in one
place, :func:`rewritten`, which gives both. Image recompression is planned (who is eligible, and to
which size), but images are not encoded again, and fonts are not subset: neither codec is available.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codecs, fonts
from ..functions.pdfvalues import references, relinked, to_json
from ..functions.text import without_subset_prefix
from ..operators import dedup, graph
from ..operators.classify import ladder
from ..options import Options
from ..session import cut
from ..sources.pdf import Tables, name_of, page_resources, pages, ref_of
from .inspect import FONT_FILES, LISTED, content_streams, font_files, integrity_warnings, traits

#: Private entries that viewers don't need, and the smallest image and font worth the work.
BLOAT = ("PieceInfo", "Thumb", "AIPrivateData1", "AIPrivateData2", "AIPrivateData3", "AIPrivateData4", "AIMetaData", "Photoshop", "IRB")
SMALL, SUSPICIOUS = 10_240, 0.5
Counters = DataFrame


_EDGE = T.StructType().add("key_path", T.ArrayType(T.StringType())).add("dst_num", T.IntegerType()).add("dst_gen", T.IntegerType())


@F.pandas_udf(T.StructType().add("dict", T.StringType()).add("refs", T.ArrayType(_EDGE)))
def rewritten(text: pd.Series, drop: pd.Series, put: pd.Series, moves: pd.Series) -> pd.DataFrame:
    """A dictionary without ``drop`` keys, with the entries of the JSON text ``put``, and references moved (arrays of from and to number); with its references."""
    dicts, refs = [], []
    for t, d, p, m in zip(text, drop, put, moves):
        value = json.loads(t)
        if isinstance(value, dict):
            value = {k: v for k, v in value.items() if d is None or k not in d} | (json.loads(p) if p else {})
        if m is not None and len(m):
            value = relinked(value, {(x["old"], x["old_gen"]): (x["new"], x["new_gen"]) for x in m})
        dicts.append(to_json(value))
        refs.append([{"key_path": list(path), "dst_num": n, "dst_gen": g} for path, n, g in references(value)])
    return pd.DataFrame({"dict": dicts, "refs": refs})


_MOVES = "array<struct<old: int, old_gen: int, new: int, new_gen: int>>"


def _changed(t: Tables, changes: DataFrame) -> Tables:
    """``changes``: file_id, obj_num, drop, put, moves, contents (null keeps the stream). Only those objects are rewritten."""
    both = t.objects.join(changes.withColumnRenamed("contents", "new_contents"), ["file_id", "obj_num"])
    done = both.withColumn("w", rewritten("dict", "drop", "put", "moves")).withColumn("contents", F.coalesce("new_contents", "contents"))
    done = cut(done.withColumn("dict", F.col("w.dict")))
    new = done.select("file_id", "obj_num", "gen_num", "kind", name_of("Type").alias("type"), name_of("Subtype").alias("subtype"), "dict", "contents", F.coalesce(F.octet_length("contents"), F.lit(0)).cast("long").alias("size"))
    edges = done.select("file_id", F.col("obj_num").alias("src_num"), F.col("gen_num").alias("src_gen"), F.explode("w.refs").alias("e")).select("file_id", "src_num", "src_gen", "e.*")
    keys = done.select("file_id", "obj_num")
    objects = t.objects.join(keys, ["file_id", "obj_num"], "left_anti").unionByName(new)
    refs = t.refs.join(keys.withColumnRenamed("obj_num", "src_num"), ["file_id", "src_num"], "left_anti").unionByName(edges)
    return replace(t, objects=cut(objects), refs=cut(refs))


def _without(t: Tables, gone: DataFrame) -> Tables:
    objects = t.objects.join(gone, ["file_id", "obj_num"], "left_anti")
    return replace(t, objects=cut(objects), refs=cut(t.refs.join(gone.withColumnRenamed("obj_num", "src_num"), ["file_id", "src_num"], "left_anti")))


def _counted(df: DataFrame, name: str) -> Counters:
    return df.groupBy("file_id").agg(F.count("*").alias("n")).select("file_id", F.lit(name).alias("counter"), "n")


def filter_array(column: str = "dict"):
    """The filter chain as an array of names; empty if there is none."""
    bare = F.regexp_replace(F.coalesce(F.get_json_object(column, "$.Filter"), F.lit("")), r'[\[\]"/\s]', "")
    return F.filter(F.split(bare, ","), lambda x: x != "")


def keeps_parameters(column: str = "dict"):
    """A predictor over 1 anywhere in the decode parameters."""
    numbers = F.regexp_extract_all(F.coalesce(F.get_json_object(column, "$.DecodeParms"), F.lit("")), F.lit(r'"Predictor":(\d+)'), 1)
    return F.exists(numbers, lambda n: n.cast("int") > 1)


def recompress(t: Tables, _: Options) -> tuple[Tables, Counters]:
    """Streams decoded and deflated at the highest level, if that is smaller; every other object is skipped with a reason."""
    plan = t.objects.withColumn("filters", filter_array()).withColumn("keep", keeps_parameters())
    stream = F.col("kind") == "stream"
    first = ladder(
        [
            (~stream, "notStream"),
            (codecs.has_image_filter(F.col("filters")), "imageFilter"),
            (~codecs.all_decodable(F.col("filters")), "undecodable"),
            (F.col("keep") & (F.size("filters") > 1), "predictorInChain"),
        ]
    )
    plan = plan.withColumn("reason", first)
    tried = plan.where("reason is null").withColumn("plain", codecs.decode_stream("contents", "filters"))
    tried = tried.withColumn("new", F.when(F.col("plain.value").isNotNull(), codecs.deflated(F.col("plain.value")))).withColumn(
        "reason",
        ladder(
            [
                (F.col("plain.error").isNotNull(), "error"),
                ((F.size("filters") > 0) & (F.octet_length("plain.value") < SUSPICIOUS * F.col("size")), "suspicious"),
                (F.octet_length("new") >= F.col("size"), "notSmaller"),
            ]
        ),
    )
    tried = cut(tried.select("file_id", "obj_num", "keep", "reason", "new"))
    won = tried.where("reason is null")
    drop = F.when(F.col("keep"), F.array(F.lit("Length"))).otherwise(F.array(F.lit("Length"), F.lit("DecodeParms")))
    put = F.concat(F.lit('{"Filter":"/FlateDecode","Length":'), F.octet_length("new").cast("string"), F.lit("}"))
    out = _changed(t, won.select("file_id", "obj_num", drop.alias("drop"), put.alias("put"), F.array().cast(_MOVES).alias("moves"), F.col("new").alias("contents")))
    skipped = plan.where("reason is not null").select("file_id", "reason").unionByName(tried.where("reason is not null").select("file_id", "reason"))
    reasons = skipped.groupBy("file_id", F.concat(F.lit("skipped:"), F.col("reason")).alias("counter")).agg(F.count("*").alias("n"))
    return out, _counted(won, "recompressed").unionByName(_counted(skipped, "skipped")).unionByName(reasons)


def image_plan(t: Tables, options: Options, page_table: DataFrame | None = None) -> DataFrame:
    """file_id, obj_num, reason (first rung that skips an image, or null), width, height, new_width, new_height: the eligibility ladder and the resolution cap. The first page that shows an image gives its size."""
    number = lambda key: F.get_json_object("dict", f"$.{key}").cast("int")
    images = t.objects.where("kind = 'stream' and subtype = 'Image'").withColumn("filters", filter_array())
    jpeg = F.exists("filters", lambda f: f.isin("DCTDecode", "DCT"))
    width, height, channels = number("Width"), number("Height"), F.when(name_of("ColorSpace") == "DeviceGray", 1).otherwise(3)
    decoded = F.when(jpeg, width * height * 4).otherwise(width * height * channels)
    reason = ladder(
        [
            (F.get_json_object("dict", "$.ImageMask") == "true", "imageMask"),
            (F.get_json_object("dict", "$.SMask").isNotNull(), "smask"),
            (F.array_contains("filters", "JPXDecode"), "jpx"),
            (~jpeg & ~codecs.all_decodable(F.col("filters")), "filters"),
            (~jpeg & (number("BitsPerComponent") != 8), "bpc"),
            (~jpeg & ~F.coalesce(name_of("ColorSpace").isin("DeviceRGB", "DeviceGray"), F.lit(False)), "colorspace"),
            (width.isNull() | height.isNull(), "dimensions"),
            (decoded < SMALL, "smallImage"),
        ]
    )
    page_table = pages(t) if page_table is None else page_table
    boxes = page_table.select("file_id", "page_no", F.col("width").alias("pw"), F.col("height").alias("ph"))
    shown = page_resources(t, page_table).where("resource = 'XObject' and name is not null").select("file_id", "page_no", F.col("dst_num").alias("obj_num")).join(boxes, ["file_id", "page_no"])
    first = shown.groupBy("file_id", "obj_num").agg(F.min_by(F.struct("pw", "ph"), "page_no").alias("box"))
    found = images.join(first, ["file_id", "obj_num"], "left").select("file_id", "obj_num", reason.alias("reason"), width.alias("width"), height.alias("height"), "box")
    dpi = F.least(F.col("width") * 72 / F.col("box.pw"), F.col("height") * 72 / F.col("box.ph"))
    scale = F.when(dpi > (options.max_dpi or 10**9), F.lit(float(options.max_dpi or 1)) / dpi)
    to = lambda side: F.greatest(F.lit(1), F.round(F.col(side) * scale)).cast("int")
    shrink = scale.isNotNull() & (to("width") < F.col("width")) & (to("height") < F.col("height"))
    return found.select("file_id", "obj_num", "reason", "width", "height", F.when(shrink, to("width")).alias("new_width"), F.when(shrink, to("height")).alias("new_height"))


def unembed(t: Tables, options: Options) -> tuple[Tables, Counters]:
    """Simple fonts that readers have are rebuilt without their descriptor and file, unless the file declares PDF/A or PDF/UA. Descriptors that another font still uses stay."""
    spark = t.objects.sparkSession
    standard = F.broadcast(spark.createDataFrame(sorted(fonts.aliases().items()), "alias string, canonical string"))
    gated = traits(t).where("is_pdf_a or is_pdf_ua").select("file_id")
    simple = t.objects.where("type = 'Font' and subtype in ('Type1', 'TrueType')").select("file_id", "obj_num", without_subset_prefix(name_of("BaseFont")).alias("alias"), ref_of("FontDescriptor").alias("descriptor"), F.get_json_object("dict", "$.Encoding.Differences").alias("differences"), F.get_json_object("dict", "$.ToUnicode").alias("unicode"), "dict")
    files = t.refs.where(F.col("key_path")[0].isin(*FONT_FILES)).select("file_id", F.col("src_num").alias("descriptor"), F.col("dst_num").alias("font_file"))
    chosen = cut(simple.where("differences is null and descriptor is not null").join(standard, "alias").join(files, ["file_id", "descriptor"]).join(gated, "file_id", "left_anti"))
    put = F.concat(
        F.lit('{"Type":"/Font","Subtype":"/Type1","BaseFont":"/'), F.col("canonical"), F.lit('","Encoding":"/WinAnsiEncoding"'),
        F.coalesce(F.concat(F.lit(',"ToUnicode":'), F.col("unicode")), F.lit("")), F.lit("}"),
    )
    keys = F.json_object_keys("dict")
    changes = chosen.dropDuplicates(["file_id", "obj_num"]).select("file_id", "obj_num", keys.alias("drop"), put.alias("put"), F.array().cast(_MOVES).alias("moves"), F.lit(None).cast("binary").alias("contents"))
    out = _changed(t, changes)
    candidates = chosen.select("file_id", F.col("descriptor").alias("obj_num")).unionByName(chosen.select("file_id", F.col("font_file").alias("obj_num"))).distinct()
    dropped = chosen.select("file_id", F.col("descriptor").alias("src_num")).distinct()
    used = out.refs.join(dropped, ["file_id", "src_num"], "left_anti").select("file_id", F.col("dst_num").alias("obj_num")).distinct()
    out = _without(out, candidates.join(used, ["file_id", "obj_num"], "left_anti"))
    return out, _counted(changes, "unembedded")


def _deduplicated(t: Tables, streams: DataFrame, key, name: str) -> tuple[Tables, Counters]:
    dups = cut(dedup.duplicate_map(streams, key, "obj_num", ("file_id",)))
    moves = t.refs.join(dups.withColumnRenamed("duplicate", "dst_num"), ["file_id", "dst_num"])
    generation = t.objects.select("file_id", F.col("obj_num").alias("canonical"), F.col("gen_num").alias("new_gen"))
    moves = moves.join(generation, ["file_id", "canonical"])
    per = moves.groupBy("file_id", F.col("src_num").alias("obj_num")).agg(F.collect_set(F.struct(F.col("dst_num").alias("old"), F.col("dst_gen").alias("old_gen"), F.col("canonical").alias("new"), "new_gen")).alias("moves"))
    out = _changed(t, per.select("file_id", "obj_num", F.array().cast("array<string>").alias("drop"), F.lit(None).cast("string").alias("put"), F.col("moves").cast(_MOVES).alias("moves"), F.lit(None).cast("binary").alias("contents")))
    out = _without(out, dups.select("file_id", F.col("duplicate").alias("obj_num")))
    return out, _counted(dups, name)


def dedup_streams(t: Tables, _: Options) -> tuple[Tables, Counters]:
    """Streams with the same entries (but for Length) and bytes become one; page contents are left alone. One pass, not a fixpoint."""
    streams = t.objects.where("kind = 'stream'").join(content_streams(t).select("file_id", "obj_num"), ["file_id", "obj_num"], "left_anti")
    entries = dedup.dict_text(F.from_json("dict", "map<string,string>"))
    return _deduplicated(t, streams, dedup.digest(entries.cast("binary"), F.col("contents")), "deduplicated")


def dedup_fonts(t: Tables, _: Options) -> tuple[Tables, Counters]:
    """Font files with the same bytes become one, whatever their entries."""
    return _deduplicated(t, t.objects.where("kind = 'stream'").join(font_files(t), ["file_id", "obj_num"], "left_semi"), dedup.digest("contents"), "deduplicated")


def strip_metadata(t: Tables, options: Options) -> tuple[Tables, Counters]:
    """Private entries go; the catalog's metadata goes unless the file declares PDF/A, after its language has moved to the catalog."""
    kinds = traits(t)
    root = t.roots.where("key = 'Root'").select("file_id", F.col("dst_num").alias("obj_num"))
    keep = F.col("is_pdf_a") | (F.lit(options.keep_conformance_metadata) & F.col("is_pdf_ua"))
    catalog = cut(root.join(t.objects, ["file_id", "obj_num"]).select("file_id", "obj_num", ref_of("Metadata").alias("meta")).join(kinds, "file_id").where(F.col("meta").isNotNull() & ~keep))
    lang = F.when(F.col("lang").isNull() & F.col("xmp_language").isNotNull(), F.concat(F.lit('{"Lang":{"s":"'), F.lower(F.hex("xmp_language")), F.lit('"}}')))
    xmp = catalog.select("file_id", "obj_num", F.lit("Metadata").alias("xmp_key"), lang.alias("put"))
    bloat = t.objects.where("kind in ('dict', 'stream')").select("file_id", "obj_num", F.array_intersect(F.json_object_keys("dict"), F.array(*map(F.lit, BLOAT))).alias("keys")).where(F.size("keys") > 0)
    both = cut(bloat.join(xmp, ["file_id", "obj_num"], "full").select("file_id", "obj_num", F.concat(F.coalesce("keys", F.array().cast("array<string>")), F.when(F.col("xmp_key").isNotNull(), F.array("xmp_key")).otherwise(F.array().cast("array<string>"))).alias("drop"), "put"))
    out = _changed(t, both.select("file_id", "obj_num", "drop", "put", F.array().cast(_MOVES).alias("moves"), F.lit(None).cast("binary").alias("contents")))
    out = _without(out, catalog.select("file_id", F.col("meta").alias("obj_num")))
    return out, both.groupBy("file_id").agg(F.sum(F.size("drop")).cast("long").alias("n")).select("file_id", F.lit("stripped").alias("counter"), "n")


def remove_unreferenced(t: Tables, _: Options) -> tuple[Tables, Counters]:
    """Objects that no path from the trailer reaches go. Must be last."""
    seeds = t.roots.select("file_id", F.col("dst_num").alias("node"))
    edges = t.refs.select("file_id", F.col("src_num").alias("src"), F.col("dst_num").alias("dst"))
    seen = graph.reachable(seeds, edges, scope=("file_id",)).withColumnRenamed("node", "obj_num")
    gone = cut(graph.orphans(t.objects.select("file_id", "obj_num"), seen, ["file_id", "obj_num"]))
    return _without(t, gone), _counted(gone, "removed")


PASSES: tuple[tuple[str, Callable], ...] = (
    ("Recompressing streams", recompress),
    ("Unembedding standard fonts", unembed),
    ("Deduplicating objects", dedup_streams),
    ("Deduplicating fonts", dedup_fonts),
    ("Stripping metadata", strip_metadata),
    ("Removing unreferenced objects", remove_unreferenced),
)


def optimize(t: Tables, options: Options = Options()) -> tuple[Tables, DataFrame]:
    """(tables, pass_stats: file_id, pass_no, pass, counter, n). A pass that fails as a whole raises; one bad object never does.

    With ``check_each_pass``, ``dangling:<kind>`` counts references from pages to nowhere that a pass brought, for all kinds of resources.
    """
    stats = None
    broken = cut(integrity_warnings(t, kinds=LISTED)) if options.check_each_pass else None
    for k, (name, step) in enumerate(PASSES):
        if step is unembed and not options.unembed:
            continue
        t, counters = step(t, options)
        if broken is not None:
            now = cut(integrity_warnings(t, kinds=LISTED))
            new = now.join(broken, now.columns, "left_anti").groupBy("file_id", F.concat(F.lit("dangling:"), F.col("resource")).alias("counter")).agg(F.count("*").alias("n"))
            broken, counters = now, counters.unionByName(new)
        rows = cut(counters.select("file_id", F.lit(k + 1).alias("pass_no"), F.lit(name).alias("pass"), "counter", "n"))
        stats = rows if stats is None else stats.unionByName(rows)
    return t, stats


def run(files: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """Files (file_id, bytes) to (file_id, bytes, kept_original), never larger and never with broken references, and pass_stats."""
    from ..sinks.pdf import guarded, write_pdf
    from ..sources.pdf import PARSED, _parsed, tables_of

    t = tables_of(cut(files.select("file_id", "bytes").mapInArrow(_parsed, PARSED)))
    done, stats = optimize(t, options)
    already = integrity_warnings(t)
    warnings = integrity_warnings(done).join(already, ["file_id", "page_no", "resource", "dst_num"], "left_anti")
    return guarded(files, write_pdf(done), warnings), stats
