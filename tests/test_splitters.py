"""Goldens and properties of the splitters, against slow loops written from the rules."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.functions.splitters import SPACES, rows, sections, sentences, tokenize


def words(text):
    t = tokenize(text)
    return [t.word(i) for i in range(len(t))]


def test_tokens():
    assert words("It's 3.14 -- a_b été!!") == ["It", "'", "s", "3", ".", "14", "--", "a", "_", "b", "é", "t", "é", "!!"]
    assert words("") == []
    assert words("中文。。ab 12") == ["中", "文", "。。", "ab", "12"]


def test_sentences_end_at_signs_lines_and_not_at_abbreviations():
    text = "Hello Mr. Smith. Yes?! \"No.\") then\nNext line\nand on"
    assert [p for p, _ in sentences(text, 18)] == ["Hello Mr. Smith.", 'Yes?! "No.") then', "Next line\nand on"]


def test_long_sentences_are_cut_at_lines_else_at_tokens_and_tokens_stay_whole():
    assert sentences("aa bb\ncc dd ee", 9) == [("aa bb", 0), ("cc dd ee", 6)]
    assert sentences("abcdefgh ij", 3) == [("abcdefgh", 0), ("ij", 9)]
    assert sentences("   ", 3) == []


STOP = re.compile("[.?!\u3002\uff01\uff1f\u0964][\"'\u00bb)\\]}]*$")
CLOSERS = re.compile("[\"'\u00bb)\\]}]+$")


def slow_end(t, first):
    from docloom.functions.splitters import ABBREVIATIONS

    for i in range(first, len(t)):
        w = t.word(i)
        if STOP.search(w):
            if w in ABBREVIATIONS or i and t.word(i - 1) + w in ABBREVIATIONS:
                continue
            end = i + 1
            while end < len(t) and CLOSERS.fullmatch(t.word(end)):
                end += 1
            return end
        if i > first and i in t.fresh and not "a" <= w[0] <= "z":
            return i
    return len(t)


prose = st.text(alphabet="ab .?!\n\")AB1é,Mr", max_size=80)


@settings(max_examples=300, deadline=None)
@given(prose, st.integers(1, 30))
def test_sentences_are_ordered_slices_that_cover_all_signs(text, most):
    got = sentences(text, most)
    t = tokenize(text)
    assert all(text[o : o + len(p)] == p for p, o in got)
    assert [o for _, o in got] == sorted({o for _, o in got})
    assert re.sub(f"[{SPACES}]", "", "".join(p for p, _ in got)) == re.sub(f"[{SPACES}]", "", text)
    assert all(len(p) <= most or len(tokenize(p)) == 1 for p, _ in got)
    for i in range(len(t)):
        assert t.sentence_end(i) == slow_end(t, i)


def test_sections():
    text = "pre\n# A\nx\n## B\n#no\n# C"
    assert sections(text, 9) == [("pre\n# A\nx"[:3], 0), ("# A\nx", 4), ("## B\n#no", 10), ("# C", 19)]
    assert sections(text, 100) == [(text, 0)]
    assert sections("", 5) == [("", 0)]
    assert sections("# A\n" + "b. " * 9 + "\n# B", 10)[-1] == ("# B", 32)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a#\n ", max_size=60))
def test_sections_rejoin(text):
    assert "\n".join(p for p, _ in sections(text, 10**6)) == text
    assert all(text[o : o + len(p)] == p for p, o in sections(text, 12))


def test_rows_repeat_the_head():
    table = "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\nend"
    head = "| a | b |\n| --- | --- |\n"
    assert rows(table, 36) == [(head + "| 1 | 2 |", 0), (head + "| 3 | 4 |", 34), ("end", 68)]
    assert rows("", 3) == [("", 0)]
    assert rows("ab\ncd", 3) == [("ab", 0), ("cd", 3)]
    assert rows("|a|\n|1|\n|2|", 8) == [("|a|\n|1|", 0), ("|a|\n|2|", 8)]  # no separator
    assert rows("|a|\n|1|\n|-|\n|2|", 100) == [("|a|\n|1|\n|-|\n|2|", 0)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n", max_size=60), st.integers(1, 20))
def test_rows_without_tables_rejoin(text, most):
    got = rows(text, most)
    assert "\n".join(p for p, _ in got) == text
    assert all(len(p) < most or "\n" not in p for p, _ in got)
    assert all(text[o : o + len(p)] == p for p, o in got)
