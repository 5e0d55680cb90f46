import base64
import random

import pytest

from echofold.llm.mail import body_text, own_words
from echofold.llm.quality import STATS, Corpus, Shape, ngram_cover, quality, repeated_cover, text_stats

PROSE = "We looked at the old plan again and I think that it should be changed before the end of the week."
HEAD = "From: a@b.example\nSubject: x\nContent-Type: text/plain; charset=utf-8\n\n"
# what the corpus of these tests would have taught, in place of ``corpus_of``
TAUGHT = Corpus(running="we at the again and i think that it should be before of wir haben den noch nicht aber das ist für uns alle し が は、 場 合 は ま し ょ う だ で す".split(), known="plan house car".split())


def kind(body, head=HEAD, corpus=TAUGHT):
    return dict(zip(STATS, text_stats(own_words(body_text(head + body)), corpus), strict=True))["kind"]


@pytest.mark.parametrize("body,want", [
    (PROSE, "prose"), (PROSE.upper(), "prose"), (PROSE.lower().replace(".", ""), "prose"),
    ("Wir haben den Plan noch nicht geprüft, aber das ist für uns alle gut.", "prose"),
    ("もし会議が古い場合は、来週確認しましょう。契約はまだです。", "prose"),
    # of languages the corpus doesn't know, by their shape
    ("Jag tror att vi ska titta på den gamla planen igen, och det är bra att du har en ny bil. Kan du komma hit i morgon och se om den går att laga?", "prose"),
    ("Non so se la macchina è già stata riparata, ma ti dico che il conto non è di certo a posto. Ne parlo con lui e poi ti do la sua risposta.", "prose"),
    ("Nie wiem, czy to jest na pewno dobre, ale on mi to dał i ja mu to oddam. Czy ty z nim o tym już mówił, bo ja nie mam na to dziś sił?", "prose"),
    ("- red house\n- blue car\n- green tree\n- old door\n- new roof", "list"),
    ("PROSE\n\n- red\n- blue".replace("PROSE", PROSE), "prose"),
    (PROSE + "\n\n" + "\n".join(f"* item {i} of wood" for i in range(40)), "list"),
    ('{\n "a": 1,\n "b": [1, 2, 3],\n "c": {"d": 5}\n}', "junk"),
    ("a\tb\tc\n1\t2\t3\n4\t5\t6\n7\t8\t9", "junk"),
    ("qwpeori zxmcn asldkfj qpwoei zmxncb alskdj qpwoe", "junk"),
    ("house plan car plan house car plan.\ncar house plan plan car car house!", "junk"),
    (" ".join(w[0] + "□" + w[1:] if len(w) > 2 else w for w in PROSE.split()), "junk"),
    ("Ð¯ Ð´Ñ�Ð¼Ð°Ñ�, Ñ�Ñ�Ð¾ Ð½Ð°Ð¼ Ð½Ð°Ð´Ð¾ Ð²Ñ�Ñ�", "junk"),
    ("red house red house " * 30, "repeated"),
    ("\n\n".join([PROSE] * 20), "repeated"),
    ("\n".join([PROSE] * 20), "repeated"),
    ("", "empty"), ("  \n \n", "empty"), ("> " + PROSE + "\n> and more", "empty"),
])
def test_kinds(body, want):
    assert kind(body) == want


def test_own_words_leave_out_what_others_wrote():
    notice = "This message is confidential."
    body = f"Hi all,\n\n{PROSE}\n\nThanks,\nBo\n-- \nBo Ng\ntel 1\n\nOn 1 May 2024, Al wrote:\n> old words\n> more\n\n____________________\n{notice}\n"
    assert own_words(body) == [PROSE, notice]
    assert own_words(f"{PROSE}\n\n-----Original Message-----\nFrom: x\nSent: y\n\n| a | b |") == [PROSE]
    assert own_words(f"Al wrote:\n> old\n\n{PROSE}\n\n________________________________\nFrom: z\nSubject: q\n\nfoo") == [PROSE]


def test_parts_and_encodings():
    b64 = base64.b64encode(PROSE.encode()).decode()
    assert body_text(f"Content-Transfer-Encoding: base64\n\n{b64}").strip() == PROSE
    assert body_text("Content-Transfer-Encoding: quoted-printable\nContent-Type: text/plain; charset=iso-8859-1\n\ngr=F6=\n=DFer") == "größer"
    multi = f'Content-Type: multipart/mixed; boundary="q"\n\npreamble\n--q\nContent-Type: text/plain\n\n{PROSE}\n--q\nContent-Type: text/html\n\n<p>no</p>\n--q\nContent-Disposition: attachment\nContent-Type: text/plain\n\nno\n--q--\n'
    assert body_text(multi).strip() == PROSE
    assert body_text(multi.replace("\n", "\r\n")).strip() == PROSE
    assert body_text("Content-Type: text/html\n\n<div>A &amp; B<br>C</div>").split() == ["A", "&", "B", "C"]
    assert body_text("Content-Transfer-Encoding: base64\n\n###") == ""
    long = "<a title='" + "word " * 2000 + "'\n>x</a> y < z"
    assert body_text("Content-Type: text/html\n\n" + long).split() == ["x", "y", "<", "z"]


def test_ngrams():
    assert ngram_cover(["a"], 2) == 0.0 and ngram_cover(["a", "b", "c", "d"], 2) == 0.0
    assert ngram_cover(["a", "b"] * 10, 2) == 1.0
    half = "one two three four five six".split()
    assert ngram_cover(half * 2, 3) == pytest.approx(2 * max(len("".join(half[i : i + 3])) for i in range(4)) / (2 * len("".join(half))))
    # a run of one word: pairs that don't overlap
    assert ngram_cover(["a"] * 5, 2) == pytest.approx(4 / 5)
    assert repeated_cover(half * 2, 5) == 0.5 and repeated_cover(half, 5) == 0.0 and repeated_cover(["a"] * 12, 5) == pytest.approx(11 / 12)


def test_ngrams_equal_counting_by_hand():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(0, 30))]
        n = rng.randint(2, 4)
        best = 0
        for gram in {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}:
            i = times = 0
            while i + n <= len(words):
                hit = tuple(words[i : i + n]) == gram
                times, i = times + hit, i + (n if hit else 1)
            best = max(best, times * len("".join(gram)) * (times > 1))
        assert ngram_cover(words, n) == pytest.approx(best / max(1, len("".join(words))))
        marked = set()
        for i in range(len(words) - n + 1):
            if any(words[j : j + n] == words[i : i + n] for j in range(i)):
                marked |= set(range(i, i + n))
        assert repeated_cover(words, n) == pytest.approx(sum(len(words[i]) for i in marked) / max(1, len("".join(words))))


def test_shapes():
    wrapped = "The old plan was changed again and we had to look\nat all of it once more. Then it was put aside, and\nnobody spoke of it."
    assert Shape(wrapped).running() and not Shape(wrapped).other() and Shape(wrapped).unforced == 0
    words = "plan house car.\nhouse car plan plan house!\ncar car\nplan house\nplan car car house car plan house plan\nhouse house."
    assert Shape(words).other() and not Shape(words).running()
    assert Shape("- a b\n- c d\n- e f").other() and Shape("1 2 3 4 5").other() and not Shape("Yes.").other()


def made_up(seed, language, content):
    """Sentences of an invented language: its function words between content words that lists use, too."""
    rng = random.Random(seed)
    function = [f"{language}{a}{b}" for a in "aeo" for b in "nrs"]
    say = lambda: " ".join(w for _ in range(6) for w in (rng.choice(function), rng.choice(function), rng.choice(content))).capitalize() + "."
    return "\n\n".join(" ".join(say() for _ in range(2)) for _ in range(2))


def test_words_and_notices_come_from_the_corpus(spark):
    rng = random.Random(1)
    things = [f"{a}{b}el" for a in "blorp krum stee vlad dron".split() for b in "in ak ut od".split()]
    notice = "Huvlo merat kopunda ersi talova minek."
    rows = [(i, f"{HEAD}{made_up(i, 'kl' if i % 4 else 'vw', things)}\n\n{notice if i % 3 else 'Blorpinel ' + str(i)}") for i in range(120)]
    rows += [(200 + i, HEAD + "\n".join(" ".join(rng.choices(things, k=2)) for _ in range(12)) + f"\n\n{notice}") for i in range(40)]
    rows += [(300 + i, HEAD + "\n".join(" ".join(rng.choices(things, k=rng.randint(3, 9))) + rng.choice(["", ".", "!"]) for _ in range(9))) for i in range(20)]
    rows += [(400, HEAD + notice), (401, HEAD + notice)]
    got = {r.id: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k, r in got.items() if r.kind == "prose"} == set(range(120))
    assert all(got[i].kind in ("junk", "list") for i in (*range(200, 240), *range(300, 320)))
    assert got[400].kind == "empty" and got[400].boilerplate == 1.0 and got[1].boilerplate > 0 and got[0].boilerplate == 0


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, HEAD + PROSE, "x"), (3, HEAD + PROSE, "x"), (4, "z" * 200_000, "x"), (None, "a\x00b", "x")], "doc_id long, text string, kind string")
    rows = {r.id: r for r in quality(df).collect()}
    assert rows[1].kind is None and rows[1].words is None
    assert rows[2].kind == "empty" and rows[3].words == 21 and rows[4].kind == "junk"
    assert quality(df).count() == 6
    assert quality(df.limit(0)).columns == ["id", *STATS] and quality(df.limit(0)).count() == 0


def test_deeply_nested_parts_and_statistics_of_all(spark, tmp_path):
    from echofold.llm.queries import p9_stats

    depth = 2000
    message = "".join(f"Content-Type: multipart/mixed; boundary=b{i}x\n\n--b{i}x\n" for i in range(depth)) + "Content-Type: text/plain\n\nalpha beta\n" + "".join(f"--b{i}x--\n" for i in reversed(range(depth)))
    assert body_text(message).strip() == "alpha beta"
    spark.createDataFrame([(1, message), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in p9_stats(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3} and set(STATS) < set(got[1].asDict()) and got[1].words == 2 and got[2].kind is None and got[3].kind == "empty"
