import math
import random
import re

from imgq.llm import licenses

WORD = re.compile(licenses.SEPARATORS)


def ascii_lower(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def words(s):
    return [w for w in WORD.split(ascii_lower(s)) if w]


def brute(rows):
    sets = [(label, set(words(t))) for label, t in licenses.TEMPLATES]
    out = []
    for d, text in rows:
        w = words(text or "")
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        found, best = {x for _, x in places}, 0.0
        base = sorted(found)
        for line in (text or "").split("\n"):
            v = words(line)
            for a in range(0, max(len(v) - 32 - 1, 0) + 1, 32):
                block = set(v[a : a + 64])
                for label, s in sets:
                    if len(s & block) >= math.ceil(0.8 * len(s) - 1e-9):
                        found.add(label)
                        best = max(best, len(s & block) / len(s))
        at = [i for i, _ in places]
        out.append((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted(found)), 1.0 if base else best))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = sorted({w for _, t in licenses.TEMPLATES for w in words(t)}) + [f"w{i}" for i in range(60)]
    rows = []
    for d in range(150):
        lines = []
        for _ in range(rng.randint(0, 4)):
            line = [rng.choice(vocab) for _ in range(rng.choice([3, 20, 150]))]
            if rng.random() < 0.5:
                t = words(rng.choice(licenses.TEMPLATES)[1])
                for _ in range(rng.randint(0, 3)):
                    t[rng.randrange(len(t))] = "x"
                at = rng.randint(0, len(line))
                line[at:at] = t
            lines.append(rng.choice([" ", ", "]).join(line))
        rows.append((d, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "..,"), (203, "CC-BY cc by, All rights\nreserved"), (204, " General  Public LICENSE! général public license"), (205, "cc  bye accc by"), (206, "Kİ cc by")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License."), (1, "nothing here"), (None, "cc by"), (None, "Released under the MIT License.")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["labels"]) for r in licenses.scan(df).collect())
    assert got == [("1", 2, ""), ("1", 5, "mit"), ("None", 2, "cc-by"), ("None", 5, "mit")]
    assert licenses.scan(df.limit(0)).count() == 0


def test_wrapped_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\")"
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:"
    gpl = "This program is free software: you can redistribute it and/or modify\n  it under the terms of the GNU General\n\tPublic License"
    narrow = "\n".join(mit.split()[:20])
    filler = " ".join(f"f{i}" for i in range(301))
    half = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof nothing"
    far = f"Permission is hereby granted, free of charge, to any person obtaining a copy\n{filler}\nof this software and associated documentation files"
    texts = [mit, bsd, gpl, narrow, f"{filler}\n{mit}\n{filler}\n{bsd}", half, far, (filler + "\n") * 3]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in got} == {
        0: ("mit", 1.0), 1: ("bsd", 1.0), 2: ("gpl", 1.0), 3: ("mit", 1.0), 4: ("bsd,mit", 1.0), 5: ("", 0.0), 6: ("", 0.0), 7: ("", 0.0),
    }
