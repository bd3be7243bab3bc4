"""Plain versions of the contracts, row by row."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"
PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}


def licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    starts, labels = [], set()
    for label, phrase in PHRASES.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def quality(text):
    text = text or ""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if x.strip(BLANK)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
    n, again = len(words), len(marked)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), again, n < 10 or 100 * again > 20 * n


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(fps):
    """fps: list of (doc_id, fp). The smallest id that links of at most 3 bits lead to."""
    up = list(range(len(fps)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j][1]).bit_count() <= 3:
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(fps))]


def pieces(ids, capacity=1024):
    ids = [*ids, 2]
    first = (len(ids) - 1) % capacity + 1
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def line_key(line):
    return line.strip(BLANK).translate(LOW)


def lines(texts, least=10):
    """texts: list of (doc_id, text) with distinct ids."""
    found = Counter(k for _, t in texts for k in {line_key(x) for x in (t or "").split("\n")})
    out = []
    for d, t in texts:
        own = (t or "").split("\n")
        kept = [x for x in own if not (line_key(x) and found[line_key(x)] >= least)]
        out.append((d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def substrings(texts, length=50):
    """texts: list of (doc_id, text); a null id comes after all."""
    key = lambda d: (d is None, d or 0)
    best = {}
    for d, t in texts:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            best[w] = min(best.get(w, key(d)), key(d))
    out = []
    for d, t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if best[raw[i : i + length]] < key(d):
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out.append((d, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def url(u, rules):
    host = path = ""
    if u and "://" in u:
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S)
        host, path = m[1].translate(LOW), m[2]
    best = None
    for verdict, rule in rules:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def archive(pages):
    """pages: list of (page_id, html)."""
    first = {}
    for p, h in sorted(pages, key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(h or "", p)
    out = []
    for p, h in pages:
        raw = (h or "").encode()
        again = len(raw) >= 100 and first[h or ""] != p
        out.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    return out


def gapless(rows, capacity=1024):
    """rows: (sequence_id, offset, length). Whether each sequence is filled from 0 without gaps."""
    by = defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            if o != at:
                return False
            at += n
        if at > capacity:
            return False
    return True


def jaccard_components(texts, least=0.8, size=5):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= least * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return [texts[top(i)][0] for i in range(len(sets))]


def grams(words, size):
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def held(words, item):
    """Whether a text holds an item by its shingles: of question and answer 0.65 each, or 0.8 of all."""
    size = min(5, len(item))
    own, there = grams(item, size), set(grams(words, size))
    cut = max(len(item) - max(1, len(item) // 4) - size + 1, 0)
    share = lambda part: len(set(part) & there) / len(set(part)) if part else 1.0
    return share(own) >= 0.8 or min(share(own[:cut]), share(own[cut:])) >= 0.65


def license_matches(text, phrases, templates):
    """Labels, covered share and number of template matches, by regular expressions over words that end in a blank."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", bytes(b + 32 if 65 <= b <= 90 else b for b in raw))
    words = [w.decode() for w in words]
    plain = lambda t: "".join(f"{re.escape(w)} " for w in re.findall(r"[a-z0-9]+", t.lower()))

    def pattern(template):
        out, at = "", 0
        for m in re.finditer(r"<<(beginOptional|endOptional|var)(?:;(.*?))?>>", template):
            out, at = out + plain(template[at : m.start()]), m.end()
            if m[1] == "beginOptional":
                out += "(?:"
            elif m[1] == "endOptional":
                out += ")?"
            else:
                said = m[2].split("=", 1)[1]
                out += {".+": r"(?:\S+ )+", ".*": r"(?:\S+ )*"}.get(said) or (rf"(?:\S+ ){said[1:]}" if said[0] == "." else f"(?:{'|'.join(plain(x) for x in said.split('|'))})")
        return re.compile(out + plain(template[at:]))

    found = []
    for label, template in {**phrases, **templates}.items():
        p = pattern(template)
        for i in range(len(words)):
            ends = [j for j in range(i + 1, len(words) + 1) if p.fullmatch("".join(f"{w} " for w in words[i:j]))]
            if ends:
                found.append((label, i, max(ends)))
    covered = {k for _, i, j in found for k in range(i, j)}
    share = len(covered) / len(words) if words else 0.0
    return ",".join(sorted({x for x, _, _ in found})), share, sum(x not in phrases for x, _, _ in found)


def repaired(rows):
    """rows: (conv_id, turn, role, text). By conv_id what op13 returns: all edit sequences by a plain best-first search over (cost, initials)."""
    import heapq

    own, out = defaultdict(list), {}
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        own[c] += []
        if kind == 1:
            x = ""
        if kind == 2:
            x = re.sub("[.!?]", "", x)
        if kind == 4:
            r = "user"
        own[c] += [(t, r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for c, have in own.items():
        have.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], hashlib.md5(v[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, r, x in have:
            black = re.sub(r"[\x20\x09-\x0D]+$", "", x)
            faults.append("blank" if not black else "duplicate" if (r, x) in seen else "truncated" if black[-1] not in ".!?" else "")
            seen.add((r, x))
        turns = [t for t, _, _ in have if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(have, have[1:], strict=False))
        heap, done = [(0, "", 0, "", ())], set()
        while heap:
            cost, edits, i, roles, kept = heapq.heappop(heap)
            if i == len(have) and re.fullmatch("(s?(ua)+)?", roles):
                break
            key = (i, roles[-1:], "u" in roles)
            if key in done:
                continue
            done.add(key)
            for given in ("user", "assistant"):
                heapq.heappush(heap, (cost + 5, edits + "I", i, roles + given[0], (*kept, f"{given}:")))
            if i < len(have):
                _, r, x = have[i]
                heapq.heappush(heap, (cost + 2, edits + "D", i + 1, roles, kept))
                if faults[i] in ("", "truncated"):
                    more = 5 if faults[i] else 0
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, roles + r[:1], (*kept, f"{r}:{x}")))
                    for given in ("user", "assistant"):
                        heapq.heappush(heap, (cost + 1 + more, edits + "R", i + 1, roles + given[0], (*kept, f"{given}:{x}")))
            heap = [h for h in heap if re.fullmatch("s?(ua)*u?", h[3])]
            heapq.heapify(heap)
        sha = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, sha)
    return out


def jaccard_rows(docs, percent=80, size=2):
    """docs: (doc_id, text). By position: shingles of the set, and the smallest id that links lead to."""
    sets = []
    for _, t in docs:
        w = [x for x in re.split(f"[{BLANK}]+", (t or "").translate(LOW)) if x]
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                up[top(i)] = top(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[top(i)].append(d)
    known = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return [(len(s), d if not s else known[top(i)]) for i, (s, (d, _)) in enumerate(zip(sets, docs, strict=True))]
