"""Plain versions of the operators, for tests only."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width, words=None):
    if words is None:
        words = WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(" ".join(words[i : i + width]) for i in range(len(words) - width + 1))


def components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if find(i) != find(j) and linked(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def near(rows, width, percent):
    """[(id, text)] -> [(id, size, component)]"""
    sets = [shingles(t, width) for _, t in rows]

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)

    group = components(len(rows), linked)
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    return [(i, len(s), least[g]) for (i, _), s, g in zip(rows, sets, group)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def pii(text):
    out = []
    for k, (kind, pattern) in enumerate(PII):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {j for i in at for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def failing_lines(text, signs="#*$%&|<>", decoration="#*$%&|<>~^_="):
    """Numbers of the lines that the rules fail, word by word."""
    lines = (text or "").split("\n")
    out, menu = set(), []
    for k, line in enumerate(lines):
        words = WORD.findall(line)
        n = len(words)
        doubled = lambda w: any(a in decoration and b in decoration for a, b in zip(w, w[1:]))
        decorated = sum(w[-1] in signs or doubled(w) for w in words)
        shouted = sum(("!!" in w or not re.search("[a-z]", w)) and bool(re.search("[A-Z]{2}|!!", w)) for w in words)
        bars = sum(not re.sub(r"::|[|>\u00bb\u00b7/]", "", w) for w in words)
        if n >= 4 and (100 * decorated > 30 * n or 100 * shouted > 60 * n or 100 * bars > 20 * n):
            out.add(k)
        phrases = ("cookie", "copyright", "all rights reserved", "terms of use", "terms of service", "privacy policy", "lorem ipsum", "javascript", "click here", "read more", "subscribe", "sign up", "log in", "login")
        if n <= 12 and any(p in line.lower() for p in phrases):
            out.add(k)
        menu.append(1 <= n <= 3 and len(line) <= 40 and not line.rstrip("\t\n\x0b\x0c\r ").endswith(tuple(".!?;:,\"')]\u2026\u3002\uff01\uff1f\u00bb\u201d")))
    for k in range(len(lines) - 2):
        if all(menu[k : k + 3]):
            out |= {k, k + 1, k + 2}
    return out


def crc(text):
    return zlib.crc32((text or "").encode())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def alignment(rows, a_path, b_path):
    """(id, text) rows -> op 13's rows, each text encoded whole, groups and links spelled out."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
    docs = []
    for i, text in rows:
        groups = []
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ba = [bytes(letters[c] for c in a.id_to_token(x)) for x in ia]
            bb = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ib]
            if b"".join(ba) == b"".join(bb) == (" " + text).encode():
                ends = [set(itertools.accumulate(map(len, x))) for x in (ba, bb)]
                at = {e: n for n, e in enumerate(sorted(ends[0] & ends[1]))}
                groups = [([], []) for _ in at]
                for side, ids, spelt in ((0, ia, ba), (1, ib, bb)):
                    n = 0
                    for x, e in zip(ids, itertools.accumulate(map(len, spelt))):
                        groups[n][side].append(x)
                        n += e in at
        docs.append((i, groups))
    counts = Counter(p for _, groups in docs for p in {p for x, y in groups for p in itertools.product(x, y)})
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for i, groups in docs:
        links = [p for x, y in groups for p in itertools.product(x, y)]
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


def first_seen(batches, least=20, seen=2):
    """[[(id, text)]] -> op 11's rows."""
    held, first, lost, out = Counter(), {}, Counter(), []
    key = lambda line: re.sub("[A-Z]+", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
    for n, rows in enumerate(batches):
        before = Counter(held)
        for i, text in rows:
            lines = (text or "").split("\n")
            keys = [key(x) for x in lines]
            gone = [len(k) >= least and before[k] >= seen for k in keys]
            held.update(set(keys))
            for k, g in zip(keys, gone):
                if g:
                    first.setdefault(k, n)
                    lost[k] += 1
            kept = "\n".join(x for x, g in zip(lines, gone) if not g)
            out.append(("doc", None if i is None else str(i), n, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out + [("line", hashlib.sha256(k.encode()).hexdigest(), first[k], held[k], n, None) for k, n in lost.items()]
