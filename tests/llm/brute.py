"""The contracts of the numbered queries, computed row by row in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tokenizer(name):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def pieces(docs, size=4096):
    """{(doc_id, piece): (start, length, crc)}"""
    tok, out = tokenizer("word_bpe_49k.json"), {}
    for doc_id, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), size):
            part = ids[at : at + size]
            out[doc_id, at // size] = (at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))
    return out


def shingles(text):
    words = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def groups(docs):
    """{doc_id: (n_shingles, component_id, kept)} by comparing every pair of sets that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    met = Counter()
    for ids in holders.values():
        for a in range(len(ids)):
            for b in range(a):
                met[min(ids[a], ids[b]), max(ids[a], ids[b])] += 1
    for (a, b), common in met.items():
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update((i, i + 1, i + 2))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    """[(kind, start, end)] by the stated patterns, which backtrack but say what is meant."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def conversations(rows):
    """{conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)}; rows are (conv_id, turn, role, text)."""
    out, by = {}, {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is None, turn, role or "", text or ""))
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss))
    return out


def encoded(docs):
    """{doc_id: (n_tokens, ids_sha256, decoded_sha256)}"""
    tok, out = tokenizer("byte_bpe_50k.json"), {}
    for doc_id, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        out[doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
    return out


def byte_values():
    """{character: byte} as byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def both_tokens(text, byte_tok, byte_names, of_char, pieces):
    """[(id, bytes)] of A and of B; two empty lists where they do not spell the space and the text."""
    if not text:
        return [], []
    a = [(i, bytes(of_char[c] for c in byte_names[i])) for i in byte_tok.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in pieces.encode(text):
        piece = pieces.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])


def spans(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def token_links(docs):
    """{doc_id: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_group_links)}, every pair of tokens compared nearby."""
    import sentencepiece

    tok = tokenizer("byte_bpe_50k.json")
    tok.encode_special_tokens = True
    names = {i: t for t, i in tok.get_vocab(with_added_tokens=False).items()}
    of_char, model = byte_values(), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found, counts = {}, Counter()
    for doc_id, text in docs:
        a, b = (spans(t) for t in both_tokens(text, tok, names, of_char, model))
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, ia, ib = [], 0, 0
        for end in ends:
            left, right = [], []
            while ia < len(a) and a[ia][2] <= end:
                left.append(a[ia][0])
                ia += 1
            while ib < len(b) and b[ib][2] <= end:
                right.append(b[ib][0])
                ib += 1
            groups.append((left, right))
        links, first = [], 0
        for i, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            k = first
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        counts.update(links)
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found[doc_id] = (len(a), len(b), len(groups), links, sha(said) if said else "", sum(len(x) * len(y) for x, y in groups))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return {
        d: (na, nb, ng, len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), digest, shared)
        for d, (na, nb, ng, links, digest, shared) in found.items()
    }


def collocations(rows, least=100, top=2000, absorb=100):
    """{lang: [(phrase, a, l, r, n, score)]}; rows are (lang, text), every phrase counted by itself."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    often = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    longer = Counter()
    for (lang, w), c in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], c)
    out = {}
    for (lang, w), a in often.items():
        if 100 * longer[lang, w] >= absorb * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((" ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    return {lang: sorted(v, key=lambda r: (-r[5], -r[1], r[0].encode()))[:top] for lang, v in out.items()}


def nearest(vectors, asked, k=20):
    """{(query_id, rank): (vec_id, score)}; vectors are (id, list)."""
    good = [(i, v) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for at, (i, q) in enumerate(good):
        if i is None or not asked(i):
            continue
        scored = []
        for other, (j, c) in enumerate(good):
            if other != at:
                total = 0.0
                for x, y in zip(q, c, strict=False):
                    total += x * y
                scored.append((-total, j is None, j or 0, other))
        for rank, (score, none, j, _) in enumerate(sorted(scored)[:k], 1):
            out.setdefault((i, rank), []).append((None if none else j, -score))
    return {key: sorted(v, key=str) for key, v in out.items()}
