"""Plain versions of the queries' contracts, without Spark and without the operators' code."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def jaccard(docs):
    """docs: (doc_id, text). Rows of (doc_id, n_shingles, component_id)."""
    docs = sorted(docs, key=lambda d: d[0])
    sets = [shingle_set(t) for _, t in docs]
    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            lists[x].append(i)
    common = Counter((a, b) for v in lists.values() for k, a in enumerate(v) for b in v[k + 1 :])
    links = [(a, b) for (a, b), k in common.items() if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k)]
    found = components(len(docs), links)
    return [(docs[i][0], len(sets[i]), docs[found[i]][0]) for i in range(len(docs))]


def library():
    """The byte-level vocabulary as the tokenizers library reads it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def pieces():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_ranges(ids, data):
    """(first byte, end) of tokens with the given bytes."""
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(data[i])))
        at += len(data[i])
    return out


def alignments(docs):
    """docs: (doc_id, text). All pairs of tokens are compared."""
    import base64

    import public_tokenizers

    a_model, b_model = library(), pieces()
    a_model.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        a_bytes = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, file)}
    names = [b_model.id_to_piece(i) for i in range(b_model.get_piece_size())]
    b_bytes = [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("\u2581", " ").encode() for x in names]
    texts, count = [], Counter()
    for d, text in docs:
        whole = f" {text}".encode() if text else b""
        a = a_model.encode(whole.decode(), add_special_tokens=False).ids if whole else []
        b = b_model.encode(text) if whole else []
        if b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            a, b = [], []
        at_a, at_b = byte_ranges(a, a_bytes), byte_ranges(b, b_bytes)
        links = [(x, y) for x, (i, j) in zip(a, at_a) for y, (k, m) in zip(b, at_b) if max(i, k) < min(j, m)]
        ends = sorted({j for _, j in at_a} & {j for _, j in at_b})
        groups, last = [], 0
        for end in ends:
            both = [",".join(str(x) for x, (_, j) in zip(ids, at) if last < j <= end) for ids, at in ((a, at_a), (b, at_b))]
            groups.append("|".join(both))
            last = end
        count.update(links)
        texts.append((d, len(a), len(b), len(ends), links, ";".join(groups)))
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [
        (d, n, m, k, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
         hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for d, n, m, k, links, groups in texts
    ]


def token_rows(docs, end_id=0):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [(d, [*t.encode(x or "", add_special_tokens=False).ids, end_id]) for d, x in docs]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def store(docs):
    out, start = [], 0
    for d, ids in token_rows(sorted(docs)):
        out.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def quality_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed)


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


def url_rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def warc_rows(pages):
    data = [(p, (h or "").encode()) for p, h in pages]
    first = {}
    for p, x in data:
        if len(x) >= 100:
            first[x] = min(p, first.get(x, p))
    return [
        (p, len(x), hashlib.sha256(x).hexdigest(), "revisit" if first.get(x, p) != p else "response",
         first[x] if first.get(x, p) != p else None)
        for p, x in data
    ]


def vector_links(rows, threshold=0.93):
    """rows: (vec_id, vector, label)."""
    rows = sorted(rows, key=lambda r: r[0])
    links, count = [], Counter()
    for i, (_, a, la) in enumerate(rows):
        for j in range(i):
            _, b, lb = rows[j]
            if la is None or la != lb or a is None or b is None or len(a) != len(b):
                continue
            x, y = (np.array([np.nan if v is None else v for v in z], float) for z in (a, b))
            if not (np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any()):
                continue
            if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links.append((i, j))
                count.update((i, j))
    found = components(len(rows), links)
    return [(rows[i][0], count[i], rows[found[i]][0], found[i] == i) for i in range(len(rows))]


def negatives(rows, divisor=100, positives=5, negatives=10):
    """rows: (vec_id, vector of whole numbers, label)."""
    out = []
    for a, x, own in rows:
        if a % divisor:
            continue
        scores = [(-sum(p * q for p, q in zip(x, y)), b, label) for b, y, label in rows if b != a]
        for top, positive in sorted((s, b) for s, b, label in scores if label == own)[:positives]:
            fit = sorted((s, b) for s, b, label in scores if label != own and 30 * -top <= 100 * -s <= 90 * -top)
            out += [(a, positive, rank, b, -top, -s) for rank, (s, b) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mix_targets(sizes):
    """sizes: {source: words}."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        price = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if price * weight[s] > 3 * sizes[s]}
        if not above:
            target |= {s: price * weight[s] for s in open_}
            break
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= above
    return target


PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def license_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
    starts = [i for i, _ in at]
    return (len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))
