"""The nearest texts of queries within one block of each, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _ends(codes: np.ndarray, n: int) -> np.ndarray:
    """Where the rows of each code begin in rows sorted by code, and their end."""
    return np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=n))))


class Texts:
    """A block of texts by text and by token. rows: key, token, w; a row without w holds the cluster of its text as its token."""

    def __init__(self, rows: pa.Table):
        weighted = pc.is_valid(rows["w"])
        named, rows = rows.filter(pc.invert(weighted)), rows.filter(weighted)
        coded, words = rows["key"].combine_chunks().dictionary_encode(), rows["token"].combine_chunks().dictionary_encode()
        order, place = pc.sort_indices(coded.dictionary).to_numpy(), np.empty(len(coded.dictionary), np.int64)
        place[order] = np.arange(len(order))
        self.keys, self.words = coded.dictionary.take(pa.array(order)), words.dictionary  # keys in order: of equal texts the first one wins
        text, token, w = place[coded.indices.to_numpy()], words.indices.to_numpy().astype(np.int64), rows["w"].to_numpy()
        by_text, by_token = np.argsort(text, kind="stable"), np.lexsort((text, token))
        self.start, self.token, self.w = _ends(text, len(self.keys)), token[by_text], w[by_text]
        self.first, self.holders = _ends(token, len(self.words)), text[by_token]
        self.most = np.maximum.reduceat(w[by_token], self.first[:-1]) if len(w) else w
        self.cluster = np.full(len(self.keys), None, object)
        at = pc.index_in(named["key"], value_set=self.keys)
        for i, c in zip(at.to_pylist(), named["token"].to_pylist()):
            if i is not None:
                self.cluster[i] = c

    def rows(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens and weights of texts, one text after the other, and where each begins."""
        begin = self.start[texts]
        n = self.start[texts + 1] - begin
        at = np.cumsum(n) - n
        flat = np.repeat(begin - at, n) + np.arange(n.sum())
        return self.token[flat], self.w[flat], at


def weighted(rows: pa.Table, n: int) -> pa.Table:
    """Rows as Texts takes them, with weights as similarity.vectors makes them over n texts. rows: key, text, df, cluster; text
    holds tokens with blanks between, or in a row with df the one token that df of all texts hold."""
    told = pc.is_valid(rows["df"])
    words, rows = rows.filter(told).sort_by("text"), rows.filter(pc.invert(told))
    parts, names = pc.split_pattern(rows["text"].combine_chunks(), " "), words["text"].combine_chunks()
    text, token = pc.list_parent_indices(parts).to_numpy(), pc.fill_null(pc.index_in(pc.list_flatten(parts), value_set=names), -1).to_numpy()
    places, tf = np.unique((text * len(names) + token)[token >= 0], return_counts=True)  # an empty text has one token, which is none
    text, token = np.divmod(places, max(1, len(names)))
    w = (1 + np.log(tf)) * np.log((n + 1) / (words["df"].to_numpy()[token] + 1))
    text, token, w = text[w > 0], token[w > 0], w[w > 0]
    w = np.floor(w / np.sqrt(np.bincount(text, w * w, minlength=1))[text] * 1e12 + 0.5) / 1e12
    made = pa.table({"key": rows["key"].take(pa.array(text)), "token": names.take(pa.array(token)), "w": pa.array(w)})
    named = rows.filter(pc.is_valid(rows["cluster"]))
    return pa.concat_tables([made, pa.table({"key": named["key"], "token": named["cluster"], "w": pa.nulls(len(named), pa.float64())})])


def nearest(queries: pa.Table, texts: pa.Table, k: int, least: float, bonus: float) -> pa.Table:
    """query, match, sim: the k most similar texts of each query. Both have key, token, w, and rows without w as Texts.

    Tokens of a query are taken in order of their weight times the greatest weight that any text gives them, the most
    promising first. Texts that hold one are scored over all tokens, until the tokens left can't reach the k-th score so far.
    """
    asked, block = Texts(queries), Texts(texts)
    known = pc.fill_null(pc.index_in(asked.words, value_set=block.words), -1).to_numpy()[asked.token]
    own = pc.fill_null(pc.index_in(asked.keys, value_set=block.keys), -1).to_numpy()
    todo = []
    for q in range(len(asked.keys)):
        mine = slice(asked.start[q], asked.start[q + 1])
        tokens, w = known[mine], asked.w[mine]
        tokens, w = tokens[tokens >= 0], w[tokens >= 0]
        if len(tokens):
            reach = w * block.most[tokens]
            order = np.lexsort((tokens, -reach))
            todo.append((q, tokens, w, tokens[order], np.cumsum(reach[order][::-1])[::-1]))
    todo.sort(key=lambda x: x[3][0])  # queries with the same first token share its rows
    weight, seen = np.zeros(len(block.words)), np.zeros(len(block.keys), bool)
    held, last = None, -1
    found_q, found_m, found_s = [], [], []
    for q, tokens, w, order, rest in todo:
        weight[tokens] = w
        best_m, best_s, floor = np.empty(0, np.int64), np.empty(0), least
        looked = []
        if own[q] >= 0:
            seen[own[q]] = True
        for i, t in enumerate(order):
            if rest[i] + bonus + 2e-6 < floor:
                break
            m = block.holders[block.first[t] : block.first[t + 1]]
            if i == 0:
                if t != last:
                    held, last = block.rows(m), t
                rows = held
            else:
                m = m[~seen[m]]
                if not len(m):
                    continue
                rows = block.rows(m)
            s = np.floor(np.add.reduceat(weight[rows[0]] * rows[1], rows[2]) * 1e6 + 0.5) / 1e6
            if bonus:
                s = s + np.where((block.cluster[m] == asked.cluster[q]) & (asked.cluster[q] is not None), bonus, 0.0)
            keep = s >= floor
            if i == 0 and own[q] >= 0:
                keep &= m != own[q]
            looked.append(m)
            seen[m] = True
            best_m, best_s = np.concatenate((best_m, m[keep])), np.concatenate((best_s, s[keep]))
            if len(best_s) >= k:
                floor = np.partition(best_s, -k)[-k]
                top = best_s >= floor
                best_m, best_s = best_m[top], best_s[top]
        top = np.lexsort((best_m, -best_s))[:k]
        found_q.append(np.full(len(top), q)), found_m.append(best_m[top]), found_s.append(best_s[top])
        weight[tokens] = 0
        for m in looked:
            seen[m] = False
        if own[q] >= 0:
            seen[own[q]] = False
    q, m, s = (np.concatenate(x) if x else np.empty(0) for x in (found_q, found_m, found_s))
    return pa.table({"query": asked.keys.take(pa.array(q.astype(np.int64))), "match": block.keys.take(pa.array(m.astype(np.int64))), "sim": pa.array(s.astype(np.float64))})
