"""What pages show: the codes of each font and their text.

Page contents are joined and tokenised once, and so is every form; a frontier loop follows ``Do`` from
pages into forms, carrying whose resources are in force; resource names meet fonts there.
A scope is a page or form (``node``) with the object that holds its resources (``holder``).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codecs, fonts, glyphs
from ..functions.tokens import called_forms, distinct_codes, shown_strings, tokenise
from ..operators import sequences
from ..session import cut, join_small, stored
from ..sources.pdf import Tables, name_of, pages
from .passes import filter_array


def _followed(t: Tables, df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` (with file_id) and ``name``: the JSON text, or that of the object it refers to."""
    there = t.objects.select("file_id", F.col("obj_num").alias("_ref"), F.col("dict").alias("_there"))
    df = df.withColumn("_text", text).withColumn("_ref", F.get_json_object("_text", "$.r[0]").cast("int"))
    return df.join(there, ["file_id", "_ref"], "left").withColumn(name, F.when(F.col("_ref").isNull(), F.col("_text")).otherwise(F.col("_there"))).drop("_text", "_ref", "_there")


def named_resources(t: Tables, holders: DataFrame, kind: str) -> DataFrame:
    """file_id, holder, name, num, dict: entries of one kind (Font, XObject) of the holders' /Resources; ``num`` is null for entries written inline. References are followed at each hop."""
    own = holders.join(t.objects.select("file_id", F.col("obj_num").alias("holder"), "dict"), ["file_id", "holder"])
    whole = _followed(t, own, F.get_json_object("dict", "$.Resources"), "resources")
    part = _followed(t, whole, F.get_json_object("resources", f"$.{kind}"), "entries")
    entry = part.select("file_id", "holder", F.explode(F.from_json("entries", "map<string,string>")).alias("name", "value"))
    number = F.get_json_object("value", "$.r[0]").cast("int").alias("num")
    return _followed(t, entry.select("file_id", "holder", "name", "value", number), F.col("value"), "dict").drop("value").where("dict is not null")


def _plain(streams: DataFrame) -> DataFrame:
    """Decoded bytes of streams; those that can't be decoded stay as they are."""
    names = streams.withColumn("filters", filter_array())
    names = names.withColumn("filters", F.when(codecs.all_decodable(F.col("filters")), F.col("filters")).otherwise(F.array().cast("array<string>")))
    return names.withColumn("data", F.coalesce(codecs.decode_stream("contents", "filters")["value"], F.col("contents"))).drop("contents", "filters")


def page_contents(t: Tables, page_table: DataFrame) -> DataFrame:
    """file_id, obj_num, data: each page's content streams, decoded and joined by a blank in their order."""
    place = lambda n: F.coalesce(F.get("key_path", F.lit(n)).cast("int"), F.lit(0))
    of_page = t.refs.where(F.col("key_path")[0] == "Contents").select("file_id", F.col("src_num").alias("obj_num"), place(1).alias("place"), F.col("dst_num").alias("stream"))
    used = page_table.select("file_id", "obj_num").join(of_page, ["file_id", "obj_num"])
    arrays = t.objects.where("kind = 'array'").select("file_id", F.col("obj_num").alias("stream"))
    inner = t.refs.where(F.size("key_path") == 1).join(arrays.withColumnRenamed("stream", "src_num"), ["file_id", "src_num"]).select("file_id", F.col("src_num").alias("stream"), place(0).alias("inner_place"), F.col("dst_num").alias("inner"))
    through = used.join(inner, ["file_id", "stream"], "left").select("file_id", "obj_num", "place", F.coalesce("inner_place", F.lit(0)).alias("inner_place"), F.coalesce("inner", "stream").alias("stream"))
    streams = t.objects.where("kind = 'stream'").select("file_id", F.col("obj_num").alias("stream"), "dict", "contents")
    needed = streams.join(through.select("file_id", "stream").distinct(), ["file_id", "stream"], "left_semi")
    parts = through.join(_plain(needed), ["file_id", "stream"])
    ordered = F.array_sort(F.collect_list(F.struct("place", "inner_place", F.hex("data").alias("digits"))))
    joined = parts.groupBy("file_id", "obj_num").agg(ordered.alias("parts"))
    return joined.select("file_id", "obj_num", F.unhex(F.concat_ws("20", F.col("parts.digits"))).alias("data"))


def scopes(t: Tables, page_table: DataFrame, calls: DataFrame, xobjects: DataFrame) -> DataFrame:
    """file_id, node, holder: pages, and the forms that ``Do`` reaches from them, each pair once, so forms that call themselves end. A form without /Resources takes its caller's."""
    form = t.objects.where("kind = 'stream' and subtype = 'Form'").select("file_id", F.col("obj_num").alias("num"), F.get_json_object("dict", "$.Resources").isNotNull().alias("own"))
    steps = xobjects.select("file_id", "holder", "name", "num").join(form, ["file_id", "num"])
    seen = cut(page_table.select("file_id", F.col("obj_num").alias("node"), F.col("resources").alias("holder")))
    frontier = seen
    while True:
        called = frontier.join(calls, ["file_id", "node"]).join(steps, ["file_id", "holder", "name"])
        following = called.select("file_id", F.col("num").alias("node"), F.when(F.col("own"), F.col("num")).otherwise(F.col("holder")).alias("holder")).distinct()
        frontier = cut(following.join(seen, ["file_id", "node", "holder"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))


def shown_fonts(t: Tables, page_table: DataFrame | None = None) -> DataFrame:
    """file_id, font, dict, str: distinct strings that pages and forms show in each font. ``font`` is the object number, or ``inline:`` and the resource name for fonts written into resources."""
    page_table = cut(pages(t) if page_table is None else page_table)
    forms = t.objects.where("kind = 'stream' and subtype = 'Form'").select("file_id", "obj_num", "dict", "contents")
    data = page_contents(t, page_table).unionByName(_plain(forms).select("file_id", "obj_num", "data"))
    found = stored(tokenise(data.select("file_id", F.col("obj_num").cast("string").alias("scope_id"), "data")))
    node = F.col("scope_id").cast("int").alias("node")
    calls = called_forms(found).select("file_id", node, "name").distinct()
    strings = shown_strings(found).select("file_id", node, F.col("font").alias("name"), "str").distinct()
    own = forms.where(F.get_json_object("dict", "$.Resources").isNotNull()).select("file_id", F.col("obj_num").alias("holder"))
    holders = page_table.select("file_id", F.col("resources").alias("holder")).where("holder is not null").unionByName(own).distinct()
    scope = scopes(t, page_table, calls, cut(named_resources(t, holders, "XObject")))
    used = scope.join(strings, ["file_id", "node"]).join(named_resources(t, holders, "Font"), ["file_id", "holder", "name"])
    return used.select("file_id", F.coalesce(F.col("num").cast("string"), F.concat(F.lit("inline:"), F.col("name"))).alias("font"), "dict", "str").distinct()


def font_kind(subtype: Column) -> Column:
    """``simple``, ``type0``, or null for fonts of other types."""
    return F.when(subtype.isin("Type1", "TrueType"), "simple").when(subtype == "Type0", "type0")


def font_codes(shown: DataFrame, *more: str) -> DataFrame:
    """file_id, font, dict, kind, code: distinct codes; two bytes each for Type0 fonts (an odd last byte is none), else one. ``more``: columns that are the same for all of a font."""
    kind = font_kind(name_of("Subtype"))
    codes = distinct_codes("str", F.coalesce(kind == "type0", F.lit(False)))
    return shown.select("file_id", "font", "dict", *more, kind.alias("kind"), F.explode(codes).alias("code")).distinct()


def identity_h(t: Tables) -> DataFrame:
    """file_id, obj_num of Type0 fonts with /Identity-H whose first descendant has no /CIDToGIDMap, or /Identity."""
    font = t.objects.where("subtype = 'Type0'").where(name_of("Encoding") == "Identity-H").select("file_id", "obj_num", "dict")
    below = _followed(t, font, F.get_json_object("dict", "$.DescendantFonts"), "list")
    first = _followed(t, below, F.get_json_object("list", "$[0]"), "cid")
    gid = F.get_json_object("cid", "$.CIDToGIDMap")
    return first.where(F.col("cid").isNotNull() & (gid.isNull() | (gid == "/Identity"))).select("file_id", "obj_num")


@F.arrow_udf(T.ArrayType(T.StructType().add("code", T.IntegerType()).add("text", T.StringType())))
def unicode_map(data: pa.Array) -> pa.Array:
    """Pairs of a ToUnicode stream; none if it can't be read."""
    out = []
    for raw in data.to_pylist():
        try:
            out.append([{"code": c, "text": s} for c, s in fonts.to_unicode((raw or b"").decode("latin-1"))])
        except ValueError:
            out.append([])
    return pa.array(out, pa.list_(pa.struct([("code", pa.int32()), ("text", pa.string())])))


def font_text(t: Tables, page_table: DataFrame | None = None) -> DataFrame:
    """file_id, font, base_font, kind, code, text: every code shown and what it stands for.

    The ToUnicode map decides; then, in fonts of one-byte codes, the glyph that /Differences or the base
    encoding (WinAnsi if none or unknown) gives, then ``uniXXXX`` names, then ASCII. Null if none of these knows.
    """
    spark = t.objects.sparkSession
    shown = stored(shown_fonts(t, page_table))
    key = ["file_id", "font", "dict"]
    font = shown.select(*key).distinct().withColumn("num", F.get_json_object("dict", "$.ToUnicode.r[0]").cast("int"))
    streams = t.objects.where("kind = 'stream'").select("file_id", F.col("obj_num").alias("num"), "contents", F.col("dict").alias("stream_dict"))
    held = streams.join(font.select("file_id", "num").distinct(), ["file_id", "num"], "left_semi").withColumnRenamed("stream_dict", "dict")
    pairs = _plain(held).select("file_id", "num", F.explode(unicode_map("data")).alias("u")).groupBy("file_id", "num", "u.code").agg(F.max("u.text").alias("mapped"))
    mapped = cut(font.join(pairs, ["file_id", "num"]).select(*key, "code", "mapped"))
    whole = cut(_followed(t, font.drop("num"), F.get_json_object("dict", "$.Encoding"), "encoding"))
    base = F.coalesce(F.when(F.col("encoding").startswith("{"), F.get_json_object("encoding", "$.BaseEncoding")).otherwise(F.col("encoding")), F.lit(""))
    bases = whole.select(*key, F.when(base.rlike("^[\"/]*MacRomanEncoding"), "MacRomanEncoding").otherwise("WinAnsiEncoding").alias("base"))
    other = _followed(t, whole, F.get_json_object("encoding", "$.Differences"), "differences")
    items = other.select(*key, F.posexplode(F.from_json("differences", "array<string>")).alias("place", "item"))
    named = sequences.running_codes(items, F.when(F.col("item").rlike(r"^[0-9.]+$"), F.col("item").cast("double").cast("long")), key, ["place"])
    glyph = named.select(*key, F.col("code").cast("int").alias("code"), F.regexp_replace("item", "^/", "").alias("glyph"), "place").groupBy(*key, "code").agg(F.max_by("glyph", "place").alias("glyph"))
    codes = font_codes(shown.join(bases, key).withColumn("base_font", name_of("BaseFont")), "base", "base_font")  # what all of a font has joins its strings, which are fewer than codes
    names = F.broadcast(spark.createDataFrame(sorted(glyphs.glyphs().items()), "glyph string, by_glyph string"))
    table = F.broadcast(spark.createDataFrame(glyphs.encodings(), "base string, code int, by_base string"))
    all_of = join_small(join_small(codes, mapped, [*key, "code"], "left"), cut(glyph), [*key, "code"], "left").join(names, "glyph", "left").join(table, ["base", "code"], "left")
    digits = F.regexp_extract(F.col("glyph"), "^uni([0-9A-Fa-f]{4})$", 1)
    by_number = F.when(F.length(digits) == 4, F.decode(F.unhex(digits), "UTF-16BE"))
    ascii_of = F.when(F.col("code").between(32, 126), F.chr(F.col("code")))
    simple = F.when(F.col("glyph").isNotNull(), F.coalesce("by_glyph", by_number)).otherwise(F.col("by_base"))
    text = F.coalesce("mapped", F.when(F.coalesce(F.col("kind"), F.lit("")) != "type0", F.coalesce(simple, ascii_of)))
    return all_of.select("file_id", "font", "base_font", "kind", "code", text.alias("text"))
