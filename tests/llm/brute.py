"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import base64
import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NO_ID = -(1 << 63)


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def warc(rows):
    """(page_id, html) to page_id, payload_bytes, payload_digest, record_type, refers_to."""
    largest = {}
    for page, html in rows:
        raw = (html or "").encode()
        if page is not None:
            largest[raw] = max(largest.get(raw, page), page)
    out, count = [], collections.Counter((html or "").encode() for _, html in rows)
    for page, html in rows:
        raw = (html or "").encode()
        original = largest.get(raw) if count[raw] > 1 else page
        revisit = original is not None and page != original
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page, len(raw), digest, "revisit" if revisit else "response", original if revisit else None))
    return sorted(out, key=str)


def substrings(docs, window=20):
    """doc_id, n_words, n_removed, kept_sha256."""
    rows = sorted((NO_ID if d is None else d, t or "") for d, t in docs)
    texts, first, out = [words(t) for _, t in rows], {}, []
    for i, w in enumerate(texts):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), (i, k))
    for (d, _), (i, w) in zip(rows, enumerate(texts), strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] != (i, k):
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((None if d == NO_ID else d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def entity(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in text.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def pii(text):
    """Base spans as kind:start:end."""
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(BASE[k], text or "") if entity(k, m[0]))


def shingles(text):
    w = words(lower(text))
    return frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def jaccard(docs):
    """doc_id, n_shingles, component_id."""
    sets, parent, holders = [shingles(t) for _, t in docs], list(range(len(docs))), collections.defaultdict(list)

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        both = collections.Counter(j for t in s for j in holders[t])
        for t in s:
            holders[t].append(i)
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if sets[i] and d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted([(d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))], key=str)


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w, seen, again = words(text), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(map((text or "").count, "#*$%&|<>")), again, len(covered), failed


def line_keys(line, leading=3, fields=3, open_words=8):
    """Templates of a line, as tuples."""
    w = words(lower(line))
    n = len(w)
    if n > 1:
        w = ["0" if re.search("[0-9]", x) else x for x in w]
    if not n:
        return []
    lead = min(leading, n)
    cuts = [lead + (n - lead) * k // fields for k in range(fields + 1)]
    parts = [tuple(w[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = [(n, tuple(w[:lead]), tuple(parts))]
    if n >= open_words:
        keys += [(n, tuple(w[:lead]), tuple(None if j == k else p for j, p in enumerate(parts))) for k in range(fields)]
    return keys


def drop_lines(docs, min_docs=10, long_words=20, long_docs=3):
    """(doc_id, text) with the lines of recurring templates dropped, but for the first of each."""
    places = collections.defaultdict(set)
    for d, t in docs:
        for i, line in enumerate((t or "").split("\n")):
            for key in line_keys(line):
                places[key].add((NO_ID if d is None else d, i))
    gone = set()
    for (n, _, parts), found in places.items():
        if len({d for d, _ in found}) >= (min(long_docs, min_docs) if n >= long_words and None not in parts else min_docs):
            gone |= set(sorted(found)[1:])
    return [(d, t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (NO_ID if d is None else d, i) not in gone)) for d, t in docs]


def contaminated(docs, items, masks=("1110010111", "1101101011", "1011110101"), least=8, enough=13, penalty=4):
    """Pairs (doc_id, item_id)."""
    out = set()
    for item, text in items:
        b = words(lower(text))
        if len(b) < least:
            continue
        own = list(masks) if len(b) >= 10 else ["1" * len(b)]
        for d, t in docs:
            w = words(lower(t))
            for shift in range(-len(b), len(w)):
                pair = [(k, k + shift) for k in range(len(b)) if 0 <= k + shift < len(w)]
                same = [b[i] == w[j] for i, j in pair]
                hit = any(all(same[s + o] for o, c in enumerate(m) if c == "1") for m in own for s in range(len(same) - len(m) + 1))
                if not hit:
                    continue
                best = now = agree = 0
                runs = 0
                for x in same:
                    now, agree = (now + 1, agree + 1) if x else (now - penalty, agree)
                    if now <= 0:
                        now = agree = 0
                    if now > best:
                        best, runs = now, agree
                if runs >= min(enough, -(-4 * len(b) // 5)):
                    out.add((d, item))
    return out
