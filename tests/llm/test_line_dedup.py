"""Line dedup against brute force on edge rows."""

from martspark.llm.line_dedup import without_repeats


def brute_force(docs):
    seen, places = {}, []
    for k, (doc_id, text) in enumerate(docs):
        if doc_id is None or text is None:
            continue
        lines = [(at, x.strip(" \t\x0b\x0c\r")) for at, x in enumerate(text.split("\n"))]
        lines = [x for x in lines if x[1]]
        for j in range(len(lines) - 2):
            part = lines[j:j + 3]
            key = tuple(x[1] for x in part)
            place = (doc_id, part[0][0])
            seen[key] = min(seen.get(key, place), place)
            places.append((k, key, place, [x[0] for x in part]))
    out = []
    for k, (doc_id, text) in enumerate(docs):
        gone = {at for j, key, place, covered in places if j == k and place > seen[key] for at in covered}
        lines = (text or "").split("\n")
        out.append((doc_id, None if text is None else "\n".join(x for at, x in enumerate(lines) if at not in gone),
                    0 if text is None else len(lines), len(gone)))
    return sorted(out, key=str)


def test_edge_rows(spark):
    block = "one a\ntwo b\nthree c\nfour d"
    docs = [(1, block), (2, "x\n" + block + "\ny"), (3, " one a \n\n two b\nthree c"), (4, None), (5, ""), (6, "\n\n\n"),
            (7, "r\nr\nr\nr\nr\nr"), (8, "one a\ntwo b"), (None, block), (9, "four d\nq"), (2, "x\n" + block + "\ny"),
            (10, "\n".join(f"line {k % 700}" for k in range(3000))), (11, block.replace("\n", "\r\n"))]
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, window string, at int")
    got = sorted((tuple(r) for r in without_repeats(df).collect()), key=str)
    assert got == brute_force(docs)


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
