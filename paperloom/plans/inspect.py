"""Where the bytes are: every object in one of six categories, rolled up per file; traits and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_subset_prefix, pdf_date, pdf_text, without_subset_prefix, xmp_fields
from ..operators import audit, graph
from ..operators.classify import ladder
from ..sources.pdf import Tables, name_of, page_resources, pages, ref_of

#: Categories in order, and file keys of font descriptors by priority.
CATEGORIES = ("Fonts", "Images", "Page Content", "Metadata", "Document Structure", "Other Data")
FONT_FILES = ("FontFile", "FontFile2", "FontFile3")


def content_streams(t: Tables, page_table: DataFrame | None = None) -> DataFrame:
    """file_id, obj_num, page_no; a stream that several pages use belongs to the last."""
    of_page = t.refs.where(F.col("key_path")[0] == "Contents").select("file_id", F.col("src_num").alias("obj_num"), F.col("dst_num").alias("stream"))
    arrays = t.refs.where(F.size("key_path") == 1).select("file_id", F.col("src_num").alias("stream"), F.col("dst_num").alias("inner"))
    through = of_page.join(arrays.join(t.objects.where("kind = 'array'").select("file_id", F.col("obj_num").alias("stream")), ["file_id", "stream"]), ["file_id", "stream"], "left")
    used = (pages(t) if page_table is None else page_table).join(through, ["file_id", "obj_num"])
    return used.groupBy("file_id", F.coalesce("inner", "stream").alias("obj_num")).agg(F.max("page_no").alias("page_no"))


def font_files(t: Tables) -> DataFrame:
    """file_id, obj_num of streams that a font descriptor names as its font file."""
    return t.refs.where(F.col("key_path")[0].isin(*FONT_FILES) & (F.size("key_path") == 1)).select("file_id", F.col("dst_num").alias("obj_num")).distinct()


def inspect_items(t: Tables, page_table: DataFrame | None = None) -> DataFrame:
    """file_id, obj_num, category, sub_category, name, detail, filter, size of every object."""
    flag = lambda df, name: df.withColumn(name, F.lit(True))
    objects = t.objects.drop("contents").join(flag(font_files(t), "is_font_file"), ["file_id", "obj_num"], "left").join(content_streams(t, page_table), ["file_id", "obj_num"], "left")
    has = lambda key: F.get_json_object("dict", f"$.{key}").isNotNull()
    stream = F.col("kind") == "stream"
    category = ladder(
        [
            (stream & (F.col("subtype") == "Image"), "Images"),
            (stream & ((F.col("type") == "Metadata") | (F.col("subtype") == "XML")), "Metadata"),
            (F.col("is_font_file"), "Fonts"),
            (F.col("type").isin("Font", "FontDescriptor"), "Fonts"),
            (F.col("page_no").isNotNull(), "Page Content"),
            (F.col("type").isin("Page", "Pages", "Catalog"), "Document Structure"),
        ],
        "Other Data",
    )
    dictionary = F.col("kind").isin("dict", "stream")
    sub = ladder(
        [
            (F.col("subtype") == "Form", "Graphics"),
            (has("N") & has("Alternate"), "Color Profiles"),
            (has("CMapName") | has("Differences") | has("Widths"), "Font Support"),
            ((F.col("type") == "Annot") | F.col("subtype").isin("Link", "Widget"), "Annotations"),
            (has("Registry"), "Font Support"),
            (dictionary, "Miscellaneous"),
        ]
    )
    image = F.concat_ws(" ", F.get_json_object("dict", "$.Width"), F.lit("×"), F.get_json_object("dict", "$.Height"), name_of("ColorSpace"))
    title = F.when(F.col("category") == "Images", image).when(F.col("type") == "Font", without_subset_prefix(name_of("BaseFont")))
    title = title.when(F.col("type") == "FontDescriptor", without_subset_prefix(name_of("FontName"))).when(F.col("category") == "Page Content", F.concat(F.lit("Page "), F.col("page_no").cast("string")))
    return objects.withColumn("category", category).select(
        "file_id", "obj_num", "category", F.when(F.col("category") == "Other Data", sub).alias("sub_category"), title.alias("name"), F.col("subtype").alias("detail"), F.get_json_object("dict", "$.Filter").alias("filter"), "size"
    )


def category_totals(items: DataFrame) -> DataFrame:
    """file_id, position, category, n, total_size: all six categories of every file."""
    spark = items.sparkSession
    labels = F.broadcast(spark.createDataFrame(list(enumerate(CATEGORIES)), "position int, category string"))
    per = items.groupBy("file_id", "category").agg(F.count("*").alias("n"), F.sum("size").alias("total_size"))
    grid = per.select("file_id").distinct().crossJoin(labels)  # six rows a file
    return grid.join(per, ["file_id", "category"], "left").na.fill(0, ["n", "total_size"])


#: Text entries of the Info dictionary, and its dates.
INFO_TEXTS, INFO_DATES = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer"), {"creation_date": "CreationDate", "modification_date": "ModDate"}


def document_info(t: Tables, page_table: DataFrame | None = None) -> DataFrame:
    """file_id, page_count, title, author, subject, keywords, creator, producer, creation_date, modification_date of every file; null for entries that are empty, missing or unreadable."""
    info = t.roots.where("key = 'Info'").join(t.objects.select("file_id", F.col("obj_num").alias("dst_num"), "dict"), ["file_id", "dst_num"]).select("file_id", "dict")
    text = lambda key: pdf_text(F.get_json_object("dict", f"$.{key}.s"))
    fields = info.select("file_id", *[text(k).alias(k.lower()) for k in INFO_TEXTS], *[pdf_date(text(k)).alias(name) for name, k in INFO_DATES.items()])
    count = (pages(t) if page_table is None else page_table).groupBy("file_id").agg(F.count("*").alias("page_count"))
    files = t.roots.where("key = 'Root'").select("file_id").distinct()
    return files.join(count, "file_id", "left").na.fill(0, ["page_count"]).join(fields, "file_id", "left")


def traits(t: Tables) -> DataFrame:
    """file_id with tagging, language, title (of the metadata, else of the Info dictionary) and conformance traits. Metadata is decoded before it is read."""
    from ..functions.codecs import decode_stream

    root = t.roots.where("key = 'Root'").select("file_id", F.col("dst_num").alias("obj_num"))
    catalog = root.join(t.objects, ["file_id", "obj_num"]).select("file_id", "dict", ref_of("Metadata").alias("meta"), F.get_json_object("dict", "$.MarkInfo.Marked").alias("marked"))
    names = F.get_json_object("dict", "$.Filter")
    filters = F.transform(F.filter(F.split(F.regexp_replace(F.coalesce(names, F.lit("")), r'[\[\]"/]', ""), ","), lambda x: x != ""), lambda x: F.trim(x))
    meta = t.objects.where((F.col("type") == "Metadata") & (F.col("kind") == "stream")).select("file_id", F.col("obj_num").alias("meta"), decode_stream("contents", filters)["value"].cast("string").alias("xmp"))
    named = t.roots.where("key = 'Info'").join(t.objects.select("file_id", F.col("obj_num").alias("dst_num"), F.col("dict").alias("info")), ["file_id", "dst_num"]).select("file_id", pdf_text(F.get_json_object("info", "$.Title.s")).alias("info_title"))
    both = catalog.join(meta, ["file_id", "meta"], "left").join(named, "file_id", "left")
    fields = xmp_fields(F.coalesce("xmp", F.lit("")))
    text = lambda key: F.nullif(F.decode(F.unhex(F.get_json_object("dict", f"$.{key}.s")), "UTF-8"), F.lit(""))
    return both.select(
        "file_id",
        F.coalesce(F.col("marked") == "true", F.lit(False)).alias("is_tagged"),
        F.coalesce("marked", F.lit("missing")).alias("marked_status"),
        F.get_json_object("dict", "$.StructTreeRoot").isNotNull().alias("has_struct_tree"),
        text("Lang").alias("lang"),
        F.coalesce(fields["title"], F.col("info_title")).alias("title"),
        fields["pdfa_part"].isNotNull().alias("is_pdf_a"),
        F.concat(fields["pdfa_part"], F.coalesce(fields["pdfa_conformance"], F.lit(""))).alias("pdf_a_level"),
        fields["pdfua_part"].isNotNull().alias("is_pdf_ua"),
        fields["language"].alias("xmp_language"),
        (F.get_json_object("dict", "$.ViewerPreferences.DisplayDocTitle") == "true").alias("display_doc_title"),
    )


def to_unicode_coverage(t: Tables) -> DataFrame:
    """file_id, total, with_it, without_it: fonts with a /ToUnicode map; Type3 and descendant fonts don't count."""
    fonts = t.objects.where("type = 'Font' and subtype not in ('Type3', 'CIDFontType0', 'CIDFontType2')")
    return audit.coverage(fonts, ref_of("ToUnicode").isNotNull(), ["file_id"])


def figure_coverage(t: Tables) -> DataFrame:
    """Figures with and without /Alt, for files that have a structure tree."""
    tagged = traits(t).where("has_struct_tree").select("file_id")
    figures = t.objects.where(F.coalesce(F.col("type") == "StructElem", F.lit(True)) & (name_of("S") == "Figure")).join(tagged, "file_id", "left_semi")
    return audit.coverage(figures, F.get_json_object("dict", "$.Alt").isNotNull(), ["file_id"])


def audits(t: Tables) -> DataFrame:
    """A row per file: fonts with and without a /ToUnicode map, images, figures with and without /Alt, and the structure tree. Figures and structure are null without a structure tree."""
    files = t.roots.where("key = 'Root'").select("file_id").distinct()
    prefixed = lambda df, name: df.select("file_id", *[F.col(c).alias(f"{name}_{c}") for c in ("total", "with_it", "without_it")])
    images = t.objects.where("kind = 'stream' and subtype = 'Image'").groupBy("file_id").agg(F.count("*").alias("images"))
    tagged = traits(t).where("has_struct_tree").select("file_id", F.lit(True).alias("has_struct_tree"))
    out = files.join(prefixed(to_unicode_coverage(t), "fonts"), "file_id", "left").join(images, "file_id", "left")
    out = out.na.fill(0, ["fonts_total", "fonts_with_it", "fonts_without_it", "images"]).join(tagged, "file_id", "left")
    out = out.join(prefixed(figure_coverage(t), "figures"), "file_id", "left").join(structure_stats(t), "file_id", "left")
    zero = lambda c: F.when(F.col("has_struct_tree"), F.coalesce(c, F.lit(0)))
    counts = ("figures_total", "figures_with_it", "figures_without_it", "elements", "max_depth")
    return out.withColumns({c: zero(F.col(c)) for c in counts}).drop("has_struct_tree")


def structure_stats(t: Tables) -> DataFrame:
    """file_id, elements, types, max_depth of the structure tree; an element has /S, roots' children are at depth 1."""
    root = t.roots.where("key = 'Root'").select("file_id", F.col("dst_num").alias("obj_num")).join(t.objects, ["file_id", "obj_num"])
    tops = root.select("file_id", ref_of("StructTreeRoot").alias("node")).where("node is not null")
    edges = t.refs.where(F.col("key_path")[0] == "K").select("file_id", F.col("src_num").alias("src"), F.col("dst_num").alias("dst"))
    tree = graph.tree_levels(tops, edges, scope=("file_id",)).where("depth > 0")
    kinds = t.objects.select("file_id", F.col("obj_num").alias("node"), name_of("S").alias("s")).where("s is not null")
    return tree.join(kinds, ["file_id", "node"]).groupBy("file_id").agg(F.count("*").alias("elements"), F.array_sort(F.collect_set("s")).alias("types"), F.max("depth").alias("max_depth"))


#: Kinds of resources that pages must find; and all kinds that a pass may not lose.
NEEDED, LISTED = ("XObject", "Font", "ExtGState"), ("Font", "XObject", "ExtGState", "ColorSpace", "Pattern", "Shading")


def integrity_warnings(t: Tables, page_table: DataFrame | None = None, kinds: tuple[str, ...] = NEEDED) -> DataFrame:
    """file_id, page_no, resource, dst_num: references from pages to contents and resources (inline, indirect or inherited) that lead nowhere."""
    page_table = pages(t) if page_table is None else page_table
    of_page = page_table.select("file_id", "page_no", F.col("obj_num").alias("src_num"))
    contents = t.refs.where(F.col("key_path")[0] == "Contents").join(of_page, ["file_id", "src_num"]).select("file_id", "page_no", F.lit("Contents").alias("resource"), "dst_num")
    used = page_resources(t, page_table).where(F.col("resource").isin("Resources", *kinds)).select("file_id", "page_no", "resource", "dst_num")
    there = t.objects.select("file_id", F.col("obj_num").alias("dst_num"))
    return graph.dangling(contents.unionByName(used).distinct(), there, ["file_id", "dst_num"])


def lossy_hint(totals: DataFrame, sizes: DataFrame, lossy: bool) -> DataFrame:
    """file_id of files for which the lossy mode is worth a try: it was off, images are over half of the bytes of streams, and less than a tenth was saved. ``sizes``: file_id, original, optimised."""
    share = totals.groupBy("file_id").agg(F.sum(F.when(F.col("category") == "Images", F.col("total_size")).otherwise(0)).alias("images"), F.sum("total_size").alias("total"))
    little = F.coalesce(F.try_divide((F.col("original") - F.col("optimised")) * 100, F.col("original")), F.lit(0)) < 10
    return share.join(sizes, "file_id").where(F.lit(not lossy) & (F.col("images") * 2 > F.col("total")) & little).select("file_id")


def subset_fonts(t: Tables) -> DataFrame:
    return t.objects.where("type = 'Font'").where(has_subset_prefix(name_of("BaseFont"))).select("file_id", "obj_num")
