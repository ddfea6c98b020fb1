import random
import re
from collections import Counter

from tallyspan.llm.quality_rules import BOILERPLATE, measures, quality_filter

LINES = [" ".join(f"word{n * 12 + k}" for k in range(12)).capitalize() + "." for n in range(10)]
GOOD = "\n".join(LINES)


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def brute_line(line):
    """The line rules as written in the docstrings, in plain Python."""
    words, chars = re.findall(r"[^\x20\x09-\x0D]+", line), re.sub(r"[\x20\x09-\x0D]", "", line)
    n, end = len(words), line.rstrip(" \t\n\x0b\x0c\r")
    bars, shouts, links = line.count("|"), line.count("!!"), [w for w in words if re.search(r"https?://.|www\..", w)]
    capitals = not any(c.islower() for c in line) and len(re.findall(r"[A-ZÀ-Þ]{2}", line)) > 1 and n >= 4
    fails = [
        bars >= 2 and bars * 4 >= n, len(links) * 2 >= n and links, len(re.findall(r"[#*$%&|<>]", line)) * 100 > len(chars) * 5, shouts > 1 and shouts * 2 >= n, capitals,
        end.endswith(("...", "…")) and n < 8, end[-1] not in ".!?:;,…。！？\"'”’»)]}|*#$%&" and n < 4, len(line) <= 300 and re.search(BOILERPLATE, line.lower()),
    ]
    return not any(fails)


def test_verdicts_equal_brute_force(docs):
    """Documents of lines of all kinds: clean text, its characters and the verdict."""
    random.seed(8)
    kinds = [
        "Menu | Home | About", "a | b", "see https://a.example/x www.b.example", "The page https://a.example tells more about it.", "WE ARE ALL IN CAPITALS HERE", "NASA and ESA met.", "NASA ESA", "和 平 的 问 题",
        "Read more about this ...", "But he did not know what to say about it…", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Política de privacidad", "BUY!! NOW!! cheap", "Home", "- item", "$$$ ## money", " \t", "x" * 310 + " cookie policy",
    ]
    texts = ["\n".join(random.choice(kinds + LINES * 2) for _ in range(random.randint(1, 25))) for _ in range(150)]
    got = {r.doc_id: r for r in measures(docs(*texts)).collect()}
    for n, t in enumerate(texts):
        left = list(dict.fromkeys(x for x in t.split("\n") if x.strip() and brute_line(x)))
        chars = len(re.sub(r"[\x20\x09-\x0D]", "", "".join(left)))
        n_words, word_chars, *_, failed = brute(t)
        assert (got[n].clean_text, got[n].left_chars, got[n].kept) == ("\n".join(left), chars, not failed and 100 * chars >= 50 * word_chars), t
    assert len({r.kept for r in got.values()}) == 2


def test_measures_equal_brute_force(docs):
    random.seed(4)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c d", "x y x y x y", GOOD, "é ü\x0bß\x0c\rñ z", "# a | b <c> *\n\n# a | b <c> *\nz"]
    texts += [" ".join(random.choice("abc") for _ in range(n)) for n in range(0, 80, 7)]
    texts += ["\n".join(random.choice(["a b", "a  b", " ", "c"]) for _ in range(20)), "w " * 30000]
    got = {r.doc_id: r for r in measures(docs(*texts)).collect()}
    for n, t in enumerate(texts):
        r = got[n]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t


def test_lines_and_verdicts(docs):
    shout = "BUY!! NOW!! CHEAP!! GOODS!! HERE!!\n"
    bars = "\n".join(" | ".join(f"item{n}x{k}" for k in range(12)) for n in range(12))
    texts = [GOOD, GOOD + "\nAll rights reserved.\nMenu", LINES[0] + "\n" + bars, shout * 4 + "".join(f"BUY{n}!! NOW{n}!! CHEAP{n}!! GOODS{n}!!\n" for n in range(20)), "&&& ".join(GOOD.split())]
    got = {r.doc_id: r for r in measures(docs(*texts)).collect()}
    assert [got[n].kept for n in range(5)] == [True, True, False, False, False]
    assert got[0].clean_text == GOOD
    assert got[1].clean_text == GOOD


def test_filter_keeps_columns_and_rows(docs, clashing):
    out = quality_filter(docs((1, GOOD), (1, GOOD), (None, GOOD), (2, "short"), (3, None))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, 1), (False, 1), (True, 0)]
    assert all(r.text == GOOD and r.n_chars == len(GOOD) and r.lang == "en" for r in out)
    wide = clashing(docs(GOOD))
    assert quality_filter(wide).columns == wide.columns
    assert quality_filter(wide.where("false")).count() == 0
