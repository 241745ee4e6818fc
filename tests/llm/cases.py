"""Small tables with the awkward rows that every operator must take."""

LONG = "longword" * 4000 + " " + " ".join(f"w{i % 97}" for i in range(30_000))

TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog."),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, LONG),
    (5, "The quick brown fox jumps over the lazy dog."),
    (5, "The quick brown fox jumps over the lazy dog."),
    (6, "Über naïve façade — 日本語 🎉  it's 12,345!\r\n\x1c'S don't <|endoftext|> x"),
    (None, "no id at all"),
    (7, "#### $$$$ a|b <c>"),
    (-8, "same line\nsame line\n\nsame line\n"),
    (9, "\n".join(["all of these words are here again and again"] * 12)),
]

# Columns of other meanings under names that operators use themselves.
EXTRA = "row string, key string, bits string, score string, votes string, shard string, n string, ids string, block string, _row int"


def documents(spark, texts=TEXTS):
    names = [c.split()[0] for c in EXTRA.split(", ")]
    rows = [(i, t, None, "src", None, *(["x"] * (len(names) - 1)), 1) for i, t in texts]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}")


def as_set(df, *columns):
    rows = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(r) for r in rows), key=repr)
