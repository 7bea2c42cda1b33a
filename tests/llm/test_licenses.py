import random

from tidemark.llm import licenses

WORDS = "the parser reads each record and writes it to a table while clerks count boxes of paper near harbour gates every morning before rain falls on empty roads".split()


def test_confirms_wordings_and_rejects_prose(spark, nothing):
    rows = [
        (1, "Lorem ipsum.\nReleased under the MIT License.\nMore text."),
        (2, "x\nThis work is licensed under the GNU General Public License, version 3."),
        (3, "This is about a driving license that someone lost on the way to the market in spring."),
        (4, licenses.TEMPLATES["apache-2.0"].capitalize()),
        (5, "This work is licensed under the GNU General Public License, version 2."),
        (6, None),
        (7, ""),
        (8, "Licensed under CC BY-NC 4.0."),
        (8, "Licensed under CC BY-NC 4.0."),
        (None, "All rights reserved."),
    ]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["license"])) for r in got) == sorted([("1", "mit-notice"), ("2", "gpl-3.0-notice"), ("3", "None"), ("4", "apache-2.0"), ("5", "gpl-2.0-notice"), ("8", "cc-by-nc-4.0"), ("8", "cc-by-nc-4.0"), ("None", "all-rights-reserved")])
    first = next(r for r in got if r["doc_id"] == 1)
    assert first["block_start"] == 13 and first["different_words"] == 0
    assert licenses.scan_licenses(nothing).count() == 0


def test_differences_are_counted_exactly():
    template = "a b c d e f".split()
    assert licenses.different_words("a b c".split(), template) == 0
    assert licenses.different_words("a x c".split(), template) == 2
    assert licenses.different_words("q".split(), template) == 1


def test_notices_inside_longer_lines():
    before, after = "The parser reads each record and writes it to a table", "bugs can be sent to the list and are answered within a week or two"
    for notice, name in (("Released under the MIT License", "mit-notice"), ("All rights reserved", "all-rights-reserved"), ("This work is licensed under the GNU General Public License, version 2", "gpl-2.0-notice")):
        for stop in (". ", " "):
            text = before + stop + notice + stop + after
            assert [(r[0], r[2]) for r in licenses.scanned(text)] == [(len(before + stop), name)]
            assert next(licenses.scanned(text))[1] == notice
    both = f"{before}. Released under the MIT License. {after}. {before}. {after}. Licensed under CC BY-NC 4.0. {after}"
    assert [r[2] for r in licenses.scanned("\u0130 " + both)] == ["mit-notice", "cc-by-nc-4.0"]
    assert [r[2] for r in licenses.scanned(f"{before} when the driving license of a clerk was lost, {after}")] == [None]


def planted(r: random.Random) -> tuple[str, str]:
    """A template (or three or more of its sentences in a row) between prose, on one line or with other line ends, some words changed."""
    name = r.choice(sorted(licenses.TEMPLATES))
    words = licenses.TEMPLATES[name].split()
    for at in r.sample(range(len(words)), len(words) // 25):
        words[at] = r.choice(WORDS)
    prose = [" ".join(r.choices(WORDS, k=r.randrange(30, 200))) for _ in range(2)]
    lines = " ".join(words) if r.random() < 0.5 else "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
    return name, f"{prose[0]} {lines} {prose[1]}"


def test_planted_notices_are_found_as_by_comparing_every_window_with_every_template():
    r = random.Random(9)
    hits = 0
    for _ in range(60):
        name, text = planted(r)
        found = [x[2] for x in licenses.scanned(text) if x[2]]
        hits += name in found
        # Brute force: the template that all windows of its length fit best.
        words = licenses.words_of(text)
        fits = {}
        for other, (own, distinct, _) in licenses.templates().items():
            spans = range(0, max(1, len(words) - len(own) + 1))
            best = max(spans, key=lambda k: sum(w in distinct for w in words[k : k + len(own)]))
            fits[other] = licenses.different_words(words[best : best + len(own)], own) / len(own)
        assert min(fits.values()) <= licenses.MOST_DIFFERENT or name not in found
    assert hits >= 54


def test_prose_has_no_license():
    r = random.Random(4)
    for _ in range(40):
        words = r.choices(WORDS, k=150)
        words[r.randrange(150)] = r.choice(["license", "copyright", "redistributed"])
        assert not [x for x in licenses.scanned(" ".join(words)) if x[2]]
