import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.pii import base_spans, disclosing_terms, find_spans, sanitise, span_digest

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    doubled = [int(d) * 2 if k % 2 else int(d) for k, d in enumerate(digits[::-1])]
    return sum(sum(map(int, str(d))) for d in doubled) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    found = [(m.start(), list(tests).index(kind), m.end(), kind) for kind, pattern in patterns.items() for m in re.finditer(pattern, text) if tests[kind](m)]
    return [(start, end, kind) for start, _, end, kind in sorted(found)]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.@-_%+019 ()é/", max_size=60))
def test_patterns_against_their_definition(text):
    assert base_spans(text) == brute(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "x.y@", "@", "d.e", ".", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "10.0.0.255", "256.1.1.1", "1.2.3.4.5.6.7.8", "+1 (499) 555-6503", "+12", "+", "0", " ", "-", "é"]), max_size=12))
def test_patterns_side_by_side(parts):
    text = "".join(parts)
    assert base_spans(text) == brute(text)


def test_hostile_texts_take_linear_time():
    began = time.perf_counter()
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1" * 200_000, "1 " * 200_000, "+1" + "(" * 400_000, "a." * 200_000 + "@"):
        base_spans(text)
    assert time.perf_counter() - began < 20


def test_counts_and_digests(spark):
    texts = {1: "Write to a.b@x.org, or +44 20 7946 0958.", 2: None, 3: "", 4: "é 10.0.0.1 and 4111 1111 1111 1111", 5: "clean text 123"}
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()] + [(4, texts[4], "x", 1), (None, "q@q.q", "x", 1)], "doc_id bigint, text string, term string, n int")
    rows = span_digest(df).collect()
    assert len(rows) == 7
    for r in rows:
        spans = brute((texts | {None: "q@q.q"})[r.doc_id] or "")
        listed = ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.spans == listed
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == kind for s in spans) for kind in ("email", "ip", "card", "phone"))
    assert span_digest(df.limit(0)).collect() == []


def corpus():
    """A signature beside one address in many letters; another address in copies of one letter; plain words."""
    dealt = random.Random(3)
    word = lambda: f"w{dealt.randrange(300)}"
    texts = [f"{' '.join(word() for _ in range(30))} Vesna Drobnik, vesna@firm.example {' '.join(word() for _ in range(30))}" for _ in range(12)]
    texts += [f"{' '.join(word() for _ in range(200))} from 9@mail.example {' '.join(word() for _ in range(9))}" for _ in range(12)]
    texts += ["uniq rarest oddest other@firm.example words copied here"] * 50
    texts += [" ".join(word() for _ in range(100)) + " from far away" for _ in range(30)] + ["it came from there", "Nobody asked Drobnik about it.", None, ""]
    return texts


def brute_terms(texts, near=5, least=3, threshold=0.95):
    count, joint, sides = Counter(), Counter(), defaultdict(lambda: (set(), set()))
    for text in texts:
        if not text:
            continue
        spans = brute(text)
        inside = lambda m: any(s < m.end() and m.start() < e for s, e, _ in spans)  # noqa: E731, B023
        words = [(m[0], m.start()) for m in re.finditer(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower()) if not inside(m)]
        count.update(w for w, _ in words)
        seen = set()
        for start, end, kind in spans:
            entity = kind, text[start:end].lower()
            before, behind = [k for k, w in enumerate(words) if w[1] < start][-near:], [k for k, w in enumerate(words) if w[1] >= start][:near]
            for k in before + behind:
                joint[entity, words[k][0]] += (entity, k) not in seen
                seen.add((entity, k))
                sides[entity, words[k][0]][0].add(tuple(words[j][0] for j in before))
                sides[entity, words[k][0]][1].add(tuple(words[j][0] for j in behind))
    total, by_entity, out = sum(count.values()), Counter(), {}
    for (entity, _), n in joint.items():
        by_entity[entity] += n
    for (entity, term), n in joint.items():
        if min(map(len, sides[entity, term])) >= least:
            p = by_entity[entity] / total
            out[term] = max(out.get(term, -9), math.log2(n / count[term] / p) / -math.log2(p))
    return {t: d for t, d in out.items() if d >= threshold}


def test_terms_against_brute_force(spark):
    texts = corpus()
    want = brute_terms(texts)
    assert {"vesna", "drobnik"} <= want.keys() and not ({"uniq", "rarest", "from"} | {f"w{k}" for k in range(300)}) & want.keys()
    for parts in (1, 5):
        df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)
        got = {r.term: r.disclosure for r in disclosing_terms(df).collect()}
        assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)


def test_terms_are_found_and_taken_out_everywhere(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in sanitise(df).collect()}
    last = rows[len(texts) - 3]
    assert last.text in ("Nobody asked  about it.", "Nobody asked [name] about it.") and [s.kind for s in last.spans] == ["term"]
    assert "[email]" in rows[0].text and "vesna" not in rows[0].text.lower() and rows[len(texts) - 2].text is None
    assert rows[40].text == texts[40].replace("other@firm.example", "[email]")


def test_more_terms_than_a_task_holds(spark):
    texts = corpus()
    df = spark.createDataFrame([(k % 90, t, "y") for k, t in enumerate(texts * 2)], "doc_id bigint, text string, spans string")
    terms = disclosing_terms(df)
    held, joined = (sorted(map(repr, find_spans(df, terms, held_terms=n).collect())) for n in (200_000, 0))
    assert held == joined and len(held) == 2 * len(texts)
