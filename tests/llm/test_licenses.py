from riskframe.llm import licenses
from llm_helpers import docs, odd_texts, real_texts

T = licenses.TEMPLATES


def brute(text):
    """Best containment over every window of every start."""
    words = licenses.words_of(text or "")
    found = {}
    for name, template in T.items():
        tw = licenses.words_of(template)
        need = {tuple(tw[i:i + 5]) for i in range(len(tw) - 4)}
        size = len(tw) + max(1, len(tw) // 4) - 1
        best = max((len(need & {tuple(words[j:j + 5]) for j in range(i, min(i + size, len(words)) - 4)}) / len(need)
                    for i in range(len(words))), default=0)
        if best >= licenses.CONTAINMENT:
            found[name] = round(best, 6)
    return found


def test_bands_guarantee_collisions():
    assert licenses.collision(licenses.LEAST_JACCARD) > 0.999


def test_same_as_brute_force(spark, sf):
    changed = T["GPL-3.0"].replace("redistribute", "share")
    texts = odd_texts()[:-5] + real_texts(spark, sf, 60) + [
        "intro words " + t + " closing words" for t in T.values()] + [
        changed, T["MIT"].upper() + " " + T["ISC"], " ".join(T["BSD"].split()[:9]), T["BSD"] * 3, "the license of the version 3"]
    got = {}
    for r in licenses.scan(docs(spark, texts)).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = r["containment"]
        words = licenses.words_of(texts[r["doc_id"]])
        assert 0 <= r["start_word"] < r["start_word"] + r["n_words"] <= len(words)
    # windows begin at multiples of the step, so the share found may lie below the best of all starts
    for i, text in enumerate(texts):
        want = brute(text)
        assert set(got.get(i, {})) <= set(want), i
        assert {n for n, s in want.items() if s == 1} <= set(got.get(i, {})), i
    assert "GPL-3.0" in got[len(texts) - 5]


def test_empty_and_clashing(spark):
    assert licenses.scan(docs(spark, ["x"]).filter("false")).count() == 0
    df = spark.createDataFrame([(None, T["MIT"], "q", 1)] * 2, "doc_id long, text string, license string, n_words int")
    assert [r["license"] for r in licenses.scan(df).collect()] == ["MIT", "MIT"]


def names(text):
    return {f[0] for f in licenses.Scanner(T).scan("some words before " + text + " and some after")}


def test_versions_are_told_apart():
    for name in ("GPL-2.0", "GPL-2.0-short", "GPL-3.0", "GPL-3.0-short", "LGPL-2.1", "LGPL-2.1-short", "LGPL-3.0", "LGPL-3.0-short", "MPL-1.1", "MPL-1.1-short", "MPL-2.0"):
        assert names(T[name]) == {name}
        assert names(T[name].replace("This ", "That ", 1).replace("The ", "These ", 1)) == {name}
    # a version without template is no other version
    assert names(T["GPL-3.0"].replace("version 3", "version 4")) == set()
    assert names(T["GPL-3.0-short"].replace("version 3", "version 1")) == set()
    assert names(T["CC-BY-4.0"].replace("4.0", "3.0")) == set()
    # each place counts by itself
    assert names(T["GPL-2.0"] + " " + T["GPL-3.0"].replace("redistribute", "share")) == {"GPL-2.0", "GPL-3.0"}


def test_required_phrases_belong_to_their_templates():
    for name, phrases in licenses.REQUIRED.items():
        text = b" %b " % b" ".join(licenses.words_of(T[name]))
        assert all(b" %b " % p.encode() in text and len(p.split()) <= licenses.SHINGLE for p in phrases)


def test_most_contained_of_one_place():
    two = {"a": "one two three four five six seven eight nine ten eleven twelve", "b": "one two three four five six seven eight nine ten eleven other"}
    assert [f[0] for f in licenses.Scanner(two).scan(two["a"])] == ["a"]
    assert [f[0] for f in licenses.Scanner(two).scan(two["a"] + " x y z " + two["b"])] == ["a", "b"]


def test_words_put_in_at_every_alignment():
    words, scanner, n = T["GPL-3.0"].split(), licenses.Scanner(T), 0
    for more in (8, 10, 12):
        for place in (10, 24):  # not inside the name or version, which must be there
            for before in range(10):
                fill = [f"x{i}" for i in range(more)]
                text = " ".join([f"y{i}" for i in range(20 + before)] + words[:place] + fill + words[place:] + ["z"] * 30)
                got, want = {f[0]: round(f[1], 6) for f in scanner.scan(text)}, brute(text)
                assert got.get("GPL-3.0") == want.get("GPL-3.0"), (more, place, before)
                n += "GPL-3.0" in want
    assert n >= 20
