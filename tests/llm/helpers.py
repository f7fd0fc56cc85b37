import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """(id, text, source) rows as documents, with extra columns named like results."""
    data = [(i, t, "en", s, None if t is None else len(t), 1, "x") for i, t, s in rows]
    return spark.createDataFrame(data, DOC + ", keep_id int, score string")


def sample_rows(n=60, seed=3):
    """Texts with copies, near copies, empty, null and odd white space, over three sources and a null one."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(200)]
    rows = []
    for i in range(n):
        text = " ".join(r.choice(words) for _ in range(r.randint(1, 120))) + "."
        if i % 9 == 4:
            text = rows[r.randrange(len(rows))][1]
        if i % 9 == 7:
            text = (rows[r.randrange(len(rows))][1] or "") + " tail"
        if i % 20 == 11:
            text = None
        if i % 20 == 13:
            text = ""
        if i % 20 == 15:
            text = "é \t\n日本 \x0b" + (text or "")
        rows.append((i, text, None if i % 13 == 5 else f"s{i % 3}"))
    return rows
