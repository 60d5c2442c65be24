import unicodedata

from hypothesis import given
from hypothesis import strategies as st

from pathloom.llm.text import COMBINING, bare, form, words

ALPHABET = st.sampled_from([*"abeX19 .,:-\t\n", *"áéñǘ", *"̧́̈̂", *"аеорсу", *"​­﻿", *" 　 ", *"ＡＢ１．", "ﬁ", "ﬄ", "−", "‐", "ο", "Α", "δ", "…", "—"])


def test_shapes():
    assert form("Ａ ́b​ cа‍́ﬁ 　 x−½² …") == "A ́b cáfi x-½² …".replace("A ́", "A ́")
    assert form("  a \t\r\n b ") == "a b"
    assert form("αβδ") == "αβδ"
    assert form("ΑΒ") == "AB"
    assert form("") == form(" ​　") == ""


def test_words_keep_marks_between_digits_only():
    assert words("A 3.5, 'b' 1..2 17:22. $x+1$ Straße—x 5, 6 e.g.") == ["a", "3.5", "b", "12", "17:22", "$x+1$", "strassex", "5", "6", "eg"]
    assert bare("Kn ife.") == bare("knife") == "knife"
    assert words("…—!?") == []


@given(st.text(ALPHABET, max_size=40))
def test_form_is_stable_and_composed(t):
    f = form(t)
    assert form(f) == f
    assert unicodedata.is_normalized("NFC", f)
    assert "  " not in f and f == f.strip()


@given(st.text(ALPHABET, max_size=40))
def test_form_ignores_decomposition(t):
    assert form(unicodedata.normalize("NFD", t)) == form(t)


def test_combining_covers_unicode():
    assert "́" in COMBINING and "a" not in COMBINING
