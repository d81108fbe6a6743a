"""Small tables for the operator tests, with the awkward rows that every operator has to stand."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, size long, hits long"
LONG = " ".join(f"w{k % 997}x{k}" for k in range(30_000))


def docs(spark, rows, partitions=3):
    """(doc_id, text[, lang[, source]]) to a documents table with extra columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or ""), "k", "r", 7, 8) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, LONG, "en", "a"), (5, "one two", "en", None), (5, "one two", "en", None), (None, "a b c d e f", None, "b"), (7, LONG, None, "a"), (8, "###", "de", "b")]
    return docs(spark, rows)


def empty(spark):
    return docs(spark, [(1, "x")]).where("false")


def oracle(sql, **tables):
    """Sorted rows of the SQL over small DataFrames, and its columns."""
    import duckdb

    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toArrow())
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    return sorted_rows(dict(zip(columns, row)) for row in found.fetchall())


def sorted_rows(rows):
    return sorted((tuple(sorted((k, v) for k, v in (r if isinstance(r, dict) else r.asDict()).items())) for r in rows), key=str)
