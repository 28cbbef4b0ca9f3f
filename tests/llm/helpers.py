"""Small tables for the operators' tests."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, _x int"


def documents(spark, texts, start=0):
    """A documents table of ``texts`` (or ``(doc_id, text)`` pairs) with two extra columns whose names clash."""
    rows = [t if isinstance(t, tuple) else (start + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "clash", 1) for i, t in rows], SCHEMA)


def groups(pairs, nodes):
    """Smallest reachable node of every node, by union and find."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def saved(spark, df, folder, name):
    """``df`` as table ``name`` of a folder with tables, for a query."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def collected(df, *keys):
    return [tuple(r) for r in df.orderBy(*[F.col(k).asc_nulls_first() for k in keys]).collect()]
