from plumbline.llm import license
from tests.llm.conftest import DOCS, prose

TEXT = dict(enumerate(license.TEMPLATES))


def found(text):
    return [(x[0], x[2], x[4]) for x in license.Scanner(license.TEMPLATES).scan(text)]


def wrapped(text, width):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) >= width:
            out.append(line)
            line = ""
        line = (line + " " + w).strip()
    return "\n".join([*out, line])


def test_every_template_in_any_line_width():
    for name, text in license.TEMPLATES:
        body = text.replace("<>", "Jane Doe")
        for width in (40, 80, 10_000):
            got = found(prose(1, 30) + "\n" + wrapped(body, width) + "\n" + prose(2, 30))
            assert (name, 0) in [(x[0], x[2]) for x in got], (name, width, got)


def test_exact_wording_differences():
    """Two licences that differ in a clause, or in one number, are told apart; changes are counted."""
    assert found(license._BSD2)[0][0] == "BSD-2-Clause"
    assert found(license._BSD3.replace("<>", "Acme"))[0][0] == "BSD-3-Clause"
    assert [x[0] for x in found(license._GPL.format("General Public License", "2"))] == ["GPL-2.0"]
    assert [x[0] for x in found(license._GPL.format("Lesser General Public License", "3"))] == ["LGPL-3.0"]
    changed = license._MIT.replace("without restriction", "with some restriction").replace("free of charge,", "")
    name, line, edits = found("x\n" + changed)[0]
    assert (name, line) == ("MIT", 2) and edits == 5


def test_alignment_against_brute_force():
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(1)
    for _ in range(150):
        a, b = ([r.choice("abc") for _ in range(r.randrange(1, 8))] for _ in range(2))
        edits, start, end = license.aligned(a, b)
        assert edits == min(distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert distance(a, b[start:end]) == edits


def test_clean_texts_and_mere_mentions():
    assert found(prose(3, 400)) == []
    assert found("He has a license to drive, and permission to park. Copyright matters.") == []


def test_oddities(odd, spark):
    assert license.scanned(odd).count() == 0
    body = "Released under the MIT License."
    rows = [(1, body, None, None, None), (1, body, "en", "s", 1), (None, prose(1, 5000) + "\r\n" + body, "en", "s", 1), (2, body + "\n" + body, "en", "s", 1)]
    got = license.scanned(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((repr(x.doc_id), x.license, x.line, x.edits) for x in got) == [("1", "MIT", 1, 0), ("1", "MIT", 1, 0), ("2", "MIT", 1, 0), ("None", "MIT", 2, 0)]
    assert license.scanned(spark.createDataFrame([], DOCS)).count() == 0


def test_short_wordings_amid_prose_in_any_line():
    """With words on all sides, in one line of a document or in one that goes on, and across line breaks."""
    for name, text in license.TEMPLATES:
        body = text.replace("<>", "Jane Doe")
        for before, after in ((prose(1, 9) + "\n", "\n" + prose(2, 40)), (prose(3, 25) + " ", " " + prose(4, 25)), (prose(5, 1200) + " ", " " + prose(6, 1200)), (prose(7, 9) + " ", "\n" + prose(8, 9))):
            for k in range(0, len(body.split()), 7):
                w = body.split()
                got = found(before + " ".join(w[:k]) + ("\n" if k else "") + " ".join(w[k:]) + after)
                assert (name, 0) in [(x[0], x[2]) for x in got], (name, k, got)


def test_wordings_with_edits_are_found():
    import random

    r = random.Random(3)
    for name, text in license.TEMPLATES:
        w = license.words(text.replace("<>", "Jane"))
        most = int(license.EDITS * len(license.words(text)) + 1e-9)
        for _ in range(10):
            new = list(w)
            for at in sorted(r.sample(range(len(w)), most), reverse=True):
                new[at : at + 1] = r.choice([[], ["changed"], [new[at], "added"]])
            block = " ".join([prose(r.randrange(99), 20), *new, prose(r.randrange(99), 20)])
            got = license.Scanner([(name, text)]).scan(block)
            assert got and got[0][4] <= most, (name, new)


def test_a_wording_beside_a_longer_one_that_holds_it():
    text = license._BSD3.replace("<>", "Acme") + "\n" + prose(1, 30) + "\n" + license._BSD2
    assert [x[0] for x in found(text)] == ["BSD-3-Clause", "BSD-2-Clause"]


def test_compression_ranks_wordings_that_overlap():
    """Three short words changed cost fewer bytes than one long word; alone, the other wording still confirms."""
    base = "Anyone may copy this work and share it with others at no cost as long as this notice stays with every copy that is made of it and the terms found at {} apply {} all copies {} all {}"
    near = base.format("quarterly-arbitration-handbook", "to", "and", "parts")
    far = base.format("consolidated-jurisdiction-memorandum", "in", "or", "bits")
    text = base.format("quarterly-arbitration-handbook", "in", "or", "bits")
    for templates in ([("near", near), ("far", far)], [("far", far), ("near", near)]):
        got = license.Scanner(templates).scan(prose(1, 30) + "\n" + text + "\n" + prose(2, 30))
        assert [(x[0], x[2], x[4]) for x in got] == [("near", 2, 3)]
    assert [(x[0], x[4]) for x in license.Scanner([("far", far)]).scan(text)] == [("far", 1)]


def test_the_scan_against_brute_force():
    """Every template against a whole text, with edits or none: the one that compresses it best is told, or one whose
    differing words are a part of its own."""
    import random
    from collections import Counter

    import zstandard

    r = random.Random(5)
    alone = zstandard.ZstdCompressor(level=license.LEVEL)
    for name, text in license.TEMPLATES:
        if license.SLOT in text:
            continue
        w = license.words(text)
        for changes in [0, *[int(license.EDITS * len(w))] * 4]:
            new = list(w)
            for at in r.sample(range(1, len(w) - 1), changes):
                new[at] = r.choice(["changed", "version", new[at - 1]])
            rivals = []
            for k, (other, wording) in enumerate(license.TEMPLATES):
                t = license.words(wording)
                edits, a, b = license.aligned(t, new)
                if edits <= int(license.EDITS * len(t) + 1e-9) and b > a:
                    part = " ".join(new[a:b]).encode()
                    given = zstandard.ZstdCompressor(level=license.LEVEL, dict_data=zstandard.ZstdCompressionDict(" ".join(t).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
                    rivals.append((len(given.compress(part)) - len(alone.compress(part)), edits / len(t), k, edits, a, b, Counter(t)))
            best = min(rivals, key=lambda x: x[:3])
            while True:
                def differing(x, y):
                    have = Counter(new[min(x[4], y[4]) : max(x[5], y[5])])
                    return (x[6] - have) + Counter({(w, "more"): n for w, n in (have - x[6]).items()})

                less = [x for x in rivals if x[3] < best[3] and differing(x, best) <= differing(best, x)]
                if not less:
                    break
                best = min(less, key=lambda x: x[3])
            got = license.Scanner(license.TEMPLATES).scan(" ".join(new))
            assert (best[2], best[3]) in [(x[1], x[4]) for x in got], (name, changes, got)
            if not changes:
                assert got[0][0] == name and got[0][4] == 0


def test_families_are_told_apart_though_sizes_are_some_bytes_off():
    """The dictionary of LGPL-3.0 compresses this text of GPL-3.0 by two bytes better."""
    text = license._GPL.format("General Public License", "3").replace("either version", "either")
    w = license.words(text)
    s = license.Scanner(license.TEMPLATES)
    by = {name: k for k, (name, t) in enumerate(license.TEMPLATES) if t.startswith("This program")}
    assert s.reduction(by["LGPL-3.0"], w) > s.reduction(by["GPL-3.0"], w)
    assert found(prose(1, 20) + "\n" + text + "\n" + prose(2, 20)) == [("GPL-3.0", 2, 1)]


def test_a_wording_told_again_is_not_given_to_its_rivals():
    """Its second place holds its words too; the place with the fewest edits is told."""
    gpl = license._GPL.format("General Public License", "2")
    assert found(gpl + "\n" + prose(1, 30) + "\n" + gpl) == [("GPL-2.0", 1, 0)]
    assert found(gpl.replace("redistribute", "share") + "\n" + gpl + "\n" + gpl) == [("GPL-2.0", 2, 0)]
    both = gpl + "\n" + license._GPL.format("Affero General Public License", "3") + "\n" + gpl
    assert [x[0] for x in found(both)] == ["GPL-2.0", "AGPL-3.0"]
