"""The search semantics in plain Python, for small corpora."""

import math
import re
import unicodedata


def tokens(text):
    out, word = [], ""
    for c in text + "\n":
        if c in "\n\r" or unicodedata.category(c)[0] in "ZP":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def jobboard(text):
    return [t for t in re.split(r"[^\w+#.]|_", text) if t]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class Model:
    def __init__(self, fields, process=lambda t: [t.lower()]):
        self.fields, self.process, self.docs, self.average, self.count = fields, process, {}, [0.0] * len(fields), 0

    def add(self, key, texts):
        doc = []
        for n, text in enumerate(texts):
            if text is None:
                doc.append(None)
                continue
            words = tokens(text)
            size = len(set(words))
            self.average[n] = (self.average[n] * self.count + size) / (self.count + 1)
            terms = {}
            for w in words:
                for t in self.process(w):
                    if t:
                        terms[t] = terms.get(t, 0) + 1
            doc.append((size, terms))
        self.docs[key] = doc
        self.count += 1

    def words(self, query):
        return [t for w in tokens(query) for t in self.process(w) if t]

    def spec(self, term, boosts, prefix, fuzzy, max_fuzzy, weights, bm25, boost=1.0):
        fuzzy = 0.2 if fuzzy is True else fuzzy or 0
        most = 0 if fuzzy <= 0 else min(max_fuzzy, math.floor(len(term) * fuzzy + 0.5)) if fuzzy < 1 else int(fuzzy)
        found, every = {}, {t for d in self.docs.values() for f in d if f for t in f[1]}
        for t in every:
            if t == term:
                w = 1.0
            elif prefix and t.startswith(term):
                w = weights[1] * len(t) / (len(t) + 0.3 * (len(t) - len(term)))
            elif most and 1 <= edits(t, term) <= most:
                w = weights[0] * len(t) / (len(t) + edits(t, term))
            else:
                continue
            for n, fb in boosts.items():
                own = {k: d[n] for k, d in self.docs.items() if d[n] and t in d[n][1]}
                idf = math.log(1 + (len(self.docs) - len(own) + 0.5) / (len(own) + 0.5))
                for k, (size, terms) in own.items():
                    if size and self.average[n]:
                        kk, b, d = bm25
                        tf = terms[t]
                        s = w * boost * fb * idf * (d + tf * (kk + 1) / (tf + kk * (1 - b + b * size / self.average[n])))
                        score, match = found.get(k, (0.0, {}))
                        match.setdefault(t, set()).add(self.fields[n])
                        found[k] = score + s, match
        return found

    def search(self, query, how="or", boosts=None, prefix=False, fuzzy=0, max_fuzzy=6, weights=(0.45, 0.375), bm25=(1.2, 0.7, 0.5)):
        """{key: (score, match map, query terms)}"""
        boosts = dict.fromkeys(range(len(self.fields)), 1.0) if boosts is None else boosts
        words = self.words(query)
        found = [self.spec(w, boosts, prefix, fuzzy, max_fuzzy, weights, bm25) for w in words]
        out = {}
        for k in self.docs:
            at = [n for n, f in enumerate(found) if k in f]
            if not at or how == "and" and len(at) < len(words) or how == "and_not" and (at[0] or len(at) > 1):
                continue
            match = {}
            for n in at:
                for t, f in found[n][k][1].items():
                    match.setdefault(t, set()).update(f)
            terms = list(dict.fromkeys(words[n] for n in at))
            out[k] = sum(found[n][k][0] for n in at) * max(1, len(terms)), match, terms
        return out
