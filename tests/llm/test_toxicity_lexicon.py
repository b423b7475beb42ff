"""Every entry of the lexicon is looked for misspelled, however many there are."""

import random

from tidemark.llm import toxicity


def test_all_entries_are_looked_for_misspelled():
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.randrange(5, 9))) for _ in range(400)})
    words, stems, fuzzy = toxicity._chosen({n: (50, 3.0) for n in names}, 1)
    assert sorted(fuzzy) == names and not stems
    lexicon = toxicity.Lexicon(words, stems, fuzzy)
    for n in names:
        at = rng.randrange(len(n))
        for odd in (f"{n[:at]}1{n[at + 1 :]}", n[:at] + n[at + 1 :], f"{n[:at]}1{n[at:]}"):
            assert lexicon.match(odd) is not None
    assert lexicon.match("zzzzzz") is None


def test_stems_are_found_in_longer_misspelled_words():
    lexicon = toxicity.Lexicon({"moron": 2.0}, {"disgustin": 3.0, "idiot": 1.0})
    for odd in ("d1sgusting", "disgustng", "disguusting", "idi0ts", "idiiotic", "ldiotically"):
        assert lexicon.match(odd)[0] == "fuzzy"
    assert lexicon.match("moronic1") is None and lexicon.match("d1sgust1ng") is None


def test_quotation_marks_are_paired():
    quoted = lambda text, word: toxicity.quoted(parts := text.split(), parts.index(word))
    assert quoted('he said "you fool there" again', "fool") and quoted("„du narr“ sagte er", "narr“")
    assert not quoted('"yes" you fool "no"', "fool")
    assert not quoted("«oui you fool there”", "fool")
    assert toxicity.quoted(['"fool"'], 0) and not toxicity.quoted(['"'], 0)
