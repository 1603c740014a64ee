"""Small tables with everything that must not break an operator."""

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
TEXTS = [
    (1, BASE),
    (2, BASE),
    (3, BASE + " nineteen"),
    (4, None),
    (5, ""),
    (6, "   \n\t "),
    (7, "two words"),
    (7, "two words"),
    (8, LONG),
    (9, LONG + " tail"),
    (10, "Mail a.b@x.org or a.b (at) x (dot) org, call +1 (499) 555-6503 or (499) 555-6503; 10.0.0.1 and 999.1.1.1"),
    (11, "card 4111 1111 1111 1111 ok 4111-1111-1111-1112 no"),
    (12, "ünï ça va 日本語 ΑΣ ς İ \x1cq\x00z <|endoftext|>"),
    (13, "you idiot you moron total trash and scum"),
    (None, "a row without an id has a text"),
]
#: Columns whose names operators use inside themselves.
EXTRA = ("n", "k", "score", "row", "_map", "comp", "sub", "side", "label", "h", "edits", "pid", "spans")


def documents(spark, rows=TEXTS, extra=True):
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", " + ", ".join(f"`{c}` string" for c in EXTRA) if extra else "")
    width = len(EXTRA) if extra else 0
    data = [(i, t, None, "s", len(t) if t is not None else None, *([None] * width)) for i, t in rows]
    return spark.createDataFrame(data, schema).repartition(3)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
