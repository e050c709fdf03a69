import random
import re

from corpusloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    places = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(label, i) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


def test_phrases_equal_brute_force():
    rng = random.Random(3)
    bits = " ".join([*licenses.PHRASES, *licenses.TEMPLATES.values()]).split() + ["Foo", "É", "mit", "cc", "by", "apache", "license"]
    scan = licenses.scanner().scan
    for _ in range(1500):
        text = rng.choice([" ", "-", ", "]).join(rng.choice([*licenses.PHRASES, *bits]).upper() if rng.random() < 0.3 else rng.choice([*licenses.PHRASES, *bits]) for _ in range(rng.randint(0, 30)))
        n, places, _ = scan(text)
        assert (n, sorted(places)) == brute(text)


def test_matching_statistics_equal_brute_force():
    rng = random.Random(5)
    templates = [[rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(5)]
    automaton = licenses.Automaton(templates)
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(200):
        words = [rng.randrange(5) for _ in range(30)]
        for k, (_, size) in enumerate(automaton.statistics(words)):
            assert size == max(n for n in range(k + 2) if n == 0 or tuple(words[k + 1 - n : k + 1]) in runs)


def test_ends_are_all_places():
    rng = random.Random(6)
    templates = [[rng.randrange(3) for _ in range(rng.randint(1, 15))] for _ in range(4)]
    automaton = licenses.Automaton(templates)
    for number, t in enumerate(templates):
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                *_, (state, size) = automaton.statistics(t[i:j])
                want = {n: [k + size - 1 for k in range(len(o) - size + 1) if o[k : k + size] == t[i:j]] for n, o in enumerate(templates)}
                assert size == j - i and automaton.ends[state] == {n: at for n, at in want.items() if at}


def test_chains_use_later_places_of_a_run():
    scan = licenses.Scanner({}, {"x": "a b c p q r a b c s t u"}).scan
    (span,) = scan("zz p q r zz a b c zz s t u")[2]
    assert span == ("x", 1, 11, 0.75)
    # overlapping runs of the text count once
    (span,) = licenses.Scanner({}, {"y": "a b c d k c d e f g"}).scan("a b c d e f g")[2]
    assert span[3] <= 0.7
    text = licenses.TEMPLATES["mit-text"]
    found = {s[0]: s[3] for s in licenses.scanner().scan("Copyright 2020 A. " + text.replace("sublicense", "licence again"))[2]}
    assert found["mit-text"] > 0.95 and found["mit-grant"] == 1.0 and "isc-text" not in found


def heaviest(pairs, length):
    """Weight of the heaviest chain, by all pairs."""
    order, best = sorted(pairs), {}
    for t, p in order:
        best[t, p] = 1 + max((best[x] for x in best if x[0] < t and x[1] < p and t - x[0] - 1 <= length), default=0)
    return max(best.values(), default=0)


def test_chains_are_heaviest():
    rng = random.Random(8)
    for _ in range(400):
        length = rng.randint(1, 12)
        pairs = set()
        for _ in range(rng.randint(0, 8)):
            t, p, n = rng.randrange(40), rng.randrange(length), rng.randint(1, 6)
            pairs |= {(t + k, p + k) for k in range(n) if p + k < length}
        found = licenses.spans_of(pairs, length)
        weight = heaviest(pairs, length)
        assert bool(found) == (weight >= licenses.LEAST_COVER * length)
        assert all(a[1] < b[0] for a, b in zip(found, found[1:], strict=False)) and sum(x[2] for x in found) >= (weight if found else 0)
        for start, end, n in found:
            assert n == heaviest({x for x in pairs if start <= x[0] <= end}, length) <= length


def test_stray_runs_are_passed_over():
    scan = licenses.scanner().scan
    for label in ("mit-text", "bsd-2-text", "zlib-text", "isc-text"):
        words = licenses.TEMPLATES[label].split()
        for stray in (words[:7], words[-7:], ["foreign"] * 7, words[len(words) // 3 : len(words) // 3 + 3]):
            for at in (len(words) // 2, len(words) // 4):
                spans = [x for x in scan(" ".join(["Copyright", *words[:at], *stray, *words[at:], "end"]))[2] if x[0] == label]
                assert len(spans) == 1 and spans[0][3] > 0.97 and spans[0][1] <= 1 + len(stray), (label, stray)
    twice = scan(" ".join([licenses.TEMPLATES["mit-text"]] * 3))[2]
    assert [round(x[3], 6) for x in twice if x[0] == "mit-text"] == [1.0] * 3


def test_own_templates(spark):
    docs = spark.createDataFrame([(1, "Do what you like with it, please")], "doc_id long, text string")
    assert [s.label for s in licenses.scan_licenses(docs, templates={"free": "do what you like with it"}).first().spans] == ["free"]


def test_spans_and_cases(spark):
    grant = licenses.TEMPLATES["mit-grant"]
    rows = [(1, None), (2, ""), (3, "x " + grant.title() + " y"), (4, " ".join(w for k, w in enumerate(grant.split()) if k != 12)), (5, "Licensed under CC BY-NC 4.0."), (6, "just a word")]
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].n_words == found[2].n_words == 0 and not found[6].spans
    assert [(s.label, s.start, s.coverage) for s in found[3].spans] == [("mit-grant", 1, 1.0)]
    assert found[4].spans[0].coverage > 0.9
    assert [(p.label, p.start) for p in found[5].places] == [("cc-by", 2)]
    assert any(s.label == "cc-by-nc-notice" for s in found[5].spans)
