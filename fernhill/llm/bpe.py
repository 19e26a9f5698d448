"""BPE ids of whole texts by a trie of words that shares the work on equal beginnings, and their text again."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from fernhill.llm._shared import documents, small_batches
from fernhill.llm._tokens import Encoder, text_groups

#: Nodes and pairs of tokens that a worker keeps, and the longest word that becomes nodes.
NODES, PAIRS, LONG_WORD = 400_000, 200_000, 256
_NEVER = 1 << 40
_END = 1 << 10
_ONE_WORD = re.compile(" ?[a-z]+")
_workers: dict[str, TrieEncoder] = {}
_tables: dict[str, tuple] = {}


class WordTrie:
    """Encodings of words under a BPE model, the beginnings of all words shared.

    A node stands for a beginning of words and holds the last token of that beginning's encoding. Two
    facts make this one token enough. A beginning's encoding without its last token is the encoding of
    a shorter beginning, which lies on the path to the root. And a row of tokens is the encoding of its
    symbols exactly if each token is its own encoding and no two neighbours would merge across their
    seam. So a new node tries the tokens that end there, the longest first, and takes the one that
    agrees with the last token of the node where it begins; a word's ids are read off backwards. The
    last symbol of a word is another symbol (marked by the model's end of word) than within.
    """

    def __init__(self, model: dict):
        vocab, mark = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merged, self.parts, self.rank = {}, {}, {}
        for rank, (a, b) in enumerate(merges):
            token = vocab[a + b]
            if token in self.parts or any(vocab[x] not in self.parts and len(x.removesuffix(mark)) != 1 for x in (a, b)):
                raise ValueError(f"merges must build each token once, from earlier ones: {a} {b}")
            self.merged[vocab[a], vocab[b]], self.parts[token], self.rank[token] = token, (vocab[a], vocab[b]), rank
        self.marked = bool(mark)
        # tokens by their symbols: within a word, and at its end
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        symbols: dict[int, tuple[str, bool]] = {}
        for word, token in sorted(vocab.items(), key=lambda x: self.rank.get(x[1], -1)):
            if token in self.parts:
                (left, ended), (right, ends) = (symbols[x] for x in self.parts[token])
                if ended:
                    continue  # nothing follows the end of a word
                symbols[token] = left + right, ends
            else:
                symbols[token] = (word.removesuffix(mark), True) if mark and len(word) > 1 else (word, False)
            text, ends = symbols[token]
            (self.final if ends else self.inner)[text] = token
        self.size = {token: len(text) for token, (text, _) in symbols.items()}
        self.starts = {text[:n] for text, ends in symbols.values() for n in range(1, len(text) + 1 - ends)}
        self.edges: dict[tuple[int, bool], list[int]] = {}
        self.own: dict[int, bool] = {}
        for known in (self.inner, self.final):  # a token that is never the encoding of its own symbols ends nothing
            for text in [text for text, token in known.items() if not self._is_own(token)]:
                del known[text]
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.last, self.reach = [-1], [0]
        self.pairs: dict[int, bool] = {}

    def _edge(self, token: int, right: bool) -> list[int]:
        """The tokens that stand at one end of a token while it is built, from its symbol to itself."""
        if (token, right) not in self.edges:
            self.edges[token, right] = (self._edge(self.parts[token][right], right) if token in self.parts else []) + [token]
        return self.edges[token, right]

    def _meet(self, u: int, v: int) -> tuple[int, bool] | None:
        """The token that first forms across the seam of two tokens' symbols, and whether both were whole then.

        Merges go by rank, and of one rank from the left: one across the seam comes before the next
        merge at the end of ``u`` only by a lower rank, before that at the start of ``v`` also by an equal one.
        """
        left, right = self._edge(u, True), self._edge(v, False)
        i = j = 0
        while True:
            next_u = self.rank[left[i + 1]] if i + 1 < len(left) else _NEVER
            next_v = self.rank[right[j + 1]] if j + 1 < len(right) else _NEVER
            made = self.merged.get((left[i], right[j]))
            if made is not None and self.rank[made] < next_u and self.rank[made] <= next_v:
                return made, next_u == next_v == _NEVER
            if next_u == next_v == _NEVER:
                return None
            if next_u <= next_v:
                i += 1
            else:
                j += 1

    def _is_own(self, token: int) -> bool:
        """Whether a token's symbols are encoded as that token."""
        if token not in self.own:
            a, b = self.parts.get(token, (-1, -1))
            self.own[token] = a < 0 or (self._is_own(a) and self._is_own(b) and self._meet(a, b) == (token, True))
        return self.own[token]

    def _apart(self, u: int, v: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[u << 32 | v] = self._meet(u, v) is None
        return found

    def _step(self, word: str, states: list[int], ends: bool, reach: int) -> tuple[int, int]:
        """The last token of the beginning that has one symbol more than ``states``, and its own reach.

        states[k - 1] is the last token of k symbols; reach is the length of the longest start of a token
        that the shorter beginning ends with, which bounds the tokens that can end here.
        """
        at, n, pairs = len(states) + 1, reach + 1, self.pairs
        known = self.final if ends else self.inner
        if not ends:
            while n > 1 and word[at - n : at] not in self.starts:
                n -= 1
        for start in range(at - n, at):
            token = known.get(word[start:at])
            if token is not None:
                if not start:
                    return token, n
                apart = pairs.get(states[start - 1] << 32 | token)
                if apart or (apart is None and self._apart(states[start - 1], token)):
                    return token, n
        raise ValueError(f"the vocabulary lacks the symbol {word[at - 1]!r}")

    def encode(self, words: set[str]) -> dict[str, list[int]]:
        """The ids of distinct words of byte symbols, in their sorted order, which is the trie's depth-first order.

        The path of the word before is kept as far as both words agree. Words of more than ``LONG_WORD``
        symbols take the same steps without leaving nodes; a trie of ``NODES`` nodes starts anew.
        """
        if len(self.last) >= NODES:
            self.clear()
        children, last, reaches, size, marked = self.children, self.last, self.reach, self.size, self.marked
        out, before = {}, ""
        states: list[int] = []  # of the path: its last tokens, and its nodes from the root on
        path = [0]
        for word in sorted(words):
            n = len(word)
            kept = n <= LONG_WORD
            k, most = 0, min(len(before), n) - marked if kept else 0
            while k < most and word[k] == before[k]:
                k += 1
            del states[k:], path[k + 1 :]
            node = path[k]
            reach = reaches[node]
            for i in range(k, n):
                ends = marked and i == n - 1
                key = node << 11 | ord(word[i]) | (_END if ends else 0)
                node = children.get(key, -1) if kept else -1
                if node < 0:
                    state, reach = self._step(word, states, ends, reach)
                    if kept:
                        node = children[key] = len(last)
                        last.append(state)
                        reaches.append(reach)
                else:
                    state, reach = last[node], reaches[node]
                states.append(state)
                path.append(node)
            before = word if kept else ""
            ids = []
            while n:
                ids.append(states[n - 1])
                n -= size[ids[-1]]
            out[word] = ids[::-1]
        return out


class TrieEncoder(Encoder):
    """An ``Encoder`` whose new pieces are parted into words by the tokenizer file's own rules and encoded by a ``WordTrie``."""

    remembered = 400_000

    def __init__(self, path: str, dtype: str = "<u2"):
        from tokenizers import Tokenizer, models

        super().__init__(path, dtype)
        about = json.loads(self.tokenizer.to_str())
        model = about["model"]
        if model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or "ByteLevel" not in json.dumps(about["pre_tokenizer"]):
            raise ValueError(f"{path} is not a plain BPE model over bytes")
        if any(x[k] for x in about["added_tokens"] for k in ("normalized", "single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that do not stand for their exact text")
        self.special = {x["content"]: x["id"] for x in about["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.trie = WordTrie(model)
        rules = Tokenizer(models.BPE())  # the library's model is not needed, and large
        if self.tokenizer.normalizer:
            rules.normalizer = self.tokenizer.normalizer
        rules.pre_tokenizer = self.tokenizer.pre_tokenizer
        self.tokenizer = rules

    def _words(self, piece: str) -> list[str | int]:
        """Words of byte symbols, and ids of the tokenizer's own tokens where a text spells them."""
        if self.folds and _ONE_WORD.fullmatch(piece):
            return [piece.lstrip()]
        out: list[str | int] = []
        for k, text in enumerate(self.split.split(piece) if self.split else [piece]):
            if k % 2:
                out.append(self.special[text])
            elif text:
                text = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
                out += [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return out

    def _ask(self, pieces: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        parted = [self._words(p) for p in pieces]
        known = self.trie.encode({w for words in parted for w in words if isinstance(w, str)})
        ids = [[i for w in words for i in (known[w] if isinstance(w, str) else [w])] for words in parted]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return [np.fromiter((i for x in ids for i in x), self.dtype, int(sizes.sum()))], np.cumsum(sizes) - sizes, sizes


def trie_encoder(path: str) -> TrieEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _workers:
        _workers[path] = TrieEncoder(path)
    return _workers[path]


def encode_documents(docs: DataFrame, tokenizer: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """The input with its text column replaced by ``out_col``, the array of the whole text's token ids.

    ``tokenizer`` is a file of the tokenizers library with a plain BPE model over bytes; ids are those
    of its call without special tokens, truncation or padding. With ``decoded_col`` the same tasks also
    decode the ids, as ``decode_documents`` does, to a column of that name. Each task encodes its own
    documents: no row moves, and a lost executor's tasks repeat alone. Null or empty text has no ids;
    other columns, null ids and repeated rows stay as they are; an input column of an output's name is
    replaced; an empty table gives none. Words of any length are encoded whole.
    """
    small_batches(docs.sparkSession)
    made = [out_col] if decoded_col is None else [out_col, decoded_col]
    kept = [c for c in docs.columns if c not in (text_col, *made)]
    rows = docs.select(*kept, F.col(text_col).alias("\0text"))

    def run(batches):
        for part, texts in text_groups(batches, "\0text", 1_000_000):
            ids, counts = trie_encoder(tokenizer).encode(texts)
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32)))
            more = [] if decoded_col is None else [_spelled(tokenizer, ids, ends)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, *more], [*kept, *made])

    schema = docs.select(*kept).schema.add(out_col, ArrayType(IntegerType()))
    return rows.mapInArrow(run, schema if decoded_col is None else schema.add(decoded_col, StringType()))


def decode_documents(tokens: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """The input with its ids replaced by ``out_col``, the text that the tokenizer file's decoder gives, special tokens included.

    A file without a decoder joins its tokens by one space; a byte decoder gives the bytes' text, with
    the replacement character for what is no UTF-8. Null ids give an empty text, ids outside the
    vocabulary and null elements give nothing; an input column named ``out_col`` is replaced.
    """
    small_batches(tokens.sparkSession)
    kept = [c for c in tokens.columns if c not in (ids_col, out_col)]
    rows = tokens.select(*kept, F.col(ids_col).cast("array<int>").alias("\0ids"))

    def run(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            ids = pc.fill_null(column.flatten(), -1).to_numpy()
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _spelled(tokenizer, ids, ends)], [*kept, out_col])

    return rows.mapInArrow(run, tokens.select(*kept).schema.add(out_col, StringType()))


def _spelled(tokenizer: str, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts of neighbouring runs of ids."""
    if tokenizer not in _tables:
        _tables[tokenizer] = decoder(tokenizer)
    table, spell = _tables[tokenizer]
    odd = (ids < 0) | (ids >= len(table))
    if odd.any():
        ends, ids = np.concatenate(([0], np.cumsum(~odd)))[ends], ids[~odd]
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return pa.array([spell(map(table.__getitem__, ids[a:z].tolist())) for a, z in zip(starts.tolist(), ends.tolist())], pa.string())


def decoder(path: str):
    """The strings of all ids, in their order, and a function that makes the text of some."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    kind = (json.loads(tokenizer.to_str())["decoder"] or {}).get("type")
    words = {i: w for w, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    if sorted(words) != list(range(len(words))):
        raise ValueError(f"{path} has gaps between its ids")
    table = [words[i] for i in range(len(words))]
    if kind is None:
        return table, " ".join
    if kind != "ByteLevel":
        raise ValueError(f"{path} has a decoder of another kind: {kind}")
    # bytes that are printable stand for themselves, the others for the characters from 256 on, in order
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    return [bytes(byte[c] for c in w) if all(c in byte for c in w) else w.encode() for w in table], lambda parts: b"".join(parts).decode("utf-8", "replace")


def op11_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    made = encode_documents(documents(spark, sf_dir).select("doc_id", "text"), path, decoded_col="decoded")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
