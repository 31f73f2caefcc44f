import math
import random
import re

from tidemark.llm.license_scan import BASE, NOTICES, PositionalIndex, scan_licenses, templates, word_idf

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for label, phrase in BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    places.sort()
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def docs():
    rng = random.Random(3)
    parts = ["under the MIT License", "Apache License, Version 2.0", "CC BY-NC 4.0", "mit", "license", "the", "under the", "cc by", "apache license version", "é", "x\x00y", "word", "2", "`", "under the mit-license"]
    rows = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    return [*rows, None, "", "...", rows[0], "pad " * 20_000 + "Released under the MIT License."]


def test_base_places(spark):
    rows = docs()
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(rows)], "doc_id bigint, text string, labels string").repartition(3)
    for r in scan_licenses(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(rows[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert scan_licenses(df.where("false")).count() == 0


def test_notices(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    texts = {
        1: "This work is licensed under the GNU General Public License, version 3.",
        2: f"(c) me. {bsd}:",
        3: bsd.replace("provided", "given").replace("following", "next"),  # two words changed
        4: "redistribution of forms is permitted",
        5: "the general public has a license, version 3",
        6: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    }
    filler = [(100 + k, "the of to and is work use general public version person files copy any") for k in range(60)]
    df = spark.createDataFrame([*texts.items(), *filler], "doc_id bigint, text string")
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    assert [got[k].labels for k in range(1, 7)] == ["gpl-3", "bsd", "bsd", "", "", "mit"]
    assert all(got[k].labels == "" and got[k].score == 0 for k, _ in filler)


def in_order(template, words, idf):
    """Weighted longest common subsequence, cell by cell."""
    table = [[0.0] * (len(words) + 1) for _ in range(len(template) + 1)]
    for i, a in enumerate(template):
        for j, b in enumerate(words):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + (idf[a] if a == b else 0))
    return table[-1][-1]


def brute_labels(texts, least=0.7, slack=6):
    """Every place of every text tried for every notice, with IDF counted anew."""
    split = [[w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] for t in texts]
    vocabulary = {w for t in templates() for w in t.words}
    idf = {w: math.log((1 + len(texts)) / (1 + sum(w in words for words in split))) + 1e-3 for w in vocabulary}
    out = []
    for words in split:
        labels, best = set(), 0.0
        for template in templates():
            key = max(template.keys, key=lambda k: (sum(idf[w] for w in k), k))
            offset = next(i for i in range(len(template.words)) if template.words[i : i + len(key)] == key)
            for at in range(len(words)):
                if tuple(words[at : at + len(key)]) != key:
                    continue
                near = words[max(0, at - offset - slack) : at - offset + len(template.words) + slack]
                if all(any(tuple(near[i : i + len(k)]) == k for i in range(len(near))) for k in template.keys):
                    share = 1.0 if template.base else min(1.0, in_order(template.words, near, idf) / sum(idf[w] for w in template.words))
                    if share >= least:
                        labels.add(template.label)
                        best = max(best, share)
        out.append((",".join(sorted(labels)), best))
    return out


def test_labels_and_score_against_brute_force(spark):
    rng = random.Random(8)
    filler = "the of to and is work use general public version person files copy any in or with this software".split()
    texts = []
    for _, notice, _ in NOTICES:
        words = notice.split()
        for edits in (0, 1, 2, len(words) // 5, len(words) // 3):
            changed = list(words)
            for _ in range(edits):
                at = rng.randrange(len(changed))
                rng.choice([lambda c, i: c.pop(i), lambda c, i: c.insert(i, rng.choice(filler)), lambda c, i: c.__setitem__(i, rng.choice(filler))])(changed, at)
            texts.append(" ".join([rng.choice(filler) for _ in range(rng.randint(0, 9))] + changed + [rng.choice(filler) for _ in range(rng.randint(0, 9))]).title())
    texts += [None, "", " ".join(filler), texts[0], f"{texts[0]} {texts[1]} under the mit license {texts[-1]}"]
    df = spark.createDataFrame([(None if k == 1 else k, k, t) for k, t in enumerate(texts)], "doc_id bigint, row int, text string").repartition(3)
    rows = scan_licenses(df, id_col="row").collect()
    want = brute_labels(texts)
    for r in rows:
        assert r.labels == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-9, texts[r.doc_id]
    assert len({r.labels for r in rows}) > 12
    assert sum(r.doc_id is None for r in scan_licenses(df).collect()) == 1


def test_a_phrase_put_in_shifts_nothing(spark):
    bsd = "Redistribution and use in full or in part in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    other = "Redistribution and use in source and binary forms, with or without any modification at all, are permitted provided that the following conditions are met"
    broken = "Redistribution and use in source and some binary forms, with or without modification, are permitted provided that the following conditions are met"
    df = spark.createDataFrame([(1, bsd), (2, other), (3, broken), *((k, "the of in and") for k in range(4, 40))], "doc_id bigint, text string")
    got = {r.doc_id: r.labels for r in scan_licenses(df).collect()}
    assert (got[1], got[2], got[3]) == ("bsd", "bsd", "")  # the third breaks the mandatory phrase


def test_words_of_one_idf_are_looked_up_in_a_fixed_order(spark):
    df = spark.createDataFrame([(k, "under the mit license " * 2) for k in range(4)], "doc_id bigint, text string")
    idf = word_idf(df)
    assert PositionalIndex(idf).ranked == PositionalIndex(dict(reversed(idf.items()))).ranked
    assert {(r.n_base, r.first_word, r.last_word, r.labels, r.score) for r in scan_licenses(df).collect()} == {(2, 0, 4, "mit", 1.0)}
