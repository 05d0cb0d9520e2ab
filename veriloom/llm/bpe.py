"""Exact byte-pair encoding by backtracking over longest token matches, and table decoding.

The encoder never applies merges one by one. An Aho-Corasick automaton gives
the longest token starting at each position of a word; a token may follow
another only if encoding the two together would give just these two (the pair
table); where no token fits, the encoder steps back. Every position is left at
most once, so the work is linear in the length of the word. The result equals
that of applying the merges in order of rank.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.workspace import tidy

#: Words remembered in each of two generations of a worker's cache; speed only, never results.
WORDS_AT_MOST = 300_000


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies (a rule, not a table)."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBPE:
    """Encoder and decoder for a ``tokenizers`` JSON file: byte letters, a suffix on the last symbol of a word.

    ``encode`` gives what the library gives with ``add_special_tokens=False``
    and no truncation or padding; ``decode_text`` what its
    ``decode(ids, skip_special_tokens=False)`` gives.
    """

    _END = 0x1000  # added to the last letter of a word, so that "letter + suffix" is one symbol

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.letters = _byte_letters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        joined = [a.removesuffix(self.suffix) + b if a.endswith(self.suffix) else a + b for a, b in merges]
        # rank: symbols that no merge makes come first, then merges in order
        made = set(joined)
        base = sorted((i, t) for t, i in vocab.items() if t not in made)
        self.rank_id = [i for i, _ in base] + [vocab[t] for t in joined]
        rank = {i: r for r, i in enumerate(self.rank_id)}
        if len(rank) != len(self.rank_id):
            raise ValueError("two merges make the same token")
        self.pairs = {(rank[vocab[a]], rank[vocab[b]]): len(base) + n for n, (a, b) in enumerate(merges)}
        self.split = [(r, r) for r in range(len(base))] + [(rank[vocab[a]], rank[vocab[b]]) for a, b in merges]
        self._valid: dict[tuple[int, int], bool] = {}

        forms = {r: self._symbols(t) for t, i in vocab.items() if (r := rank.get(i)) is not None}
        self.length = [len(forms[r]) for r in range(len(forms))]
        # a token whose parts would not be merged into it in a text of its own never occurs
        usable = [r for r in forms if self.split[r] == (r, r) or self.compatible_as_merge(r)]
        by_form = {forms[r]: r for r in usable}
        self.shorter = {}
        for r in usable:
            form = forms[r]
            self.shorter[r] = next((by_form[form[:n]] for n in range(len(form) - 1, 0, -1) if form[:n] in by_form), -1)
        self.automaton = ahocorasick.Automaton()
        for form, r in by_form.items():
            self.automaton.add_word(form, r)
        self.automaton.make_automaton()

        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.specials = specials
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        parts = (spec["pre_tokenizer"].get("pretokenizers") or [spec["pre_tokenizer"]])[0]
        self._piece = regex.compile(parts["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        # decoding: token i is blob[offsets[i]:offsets[i + 1]]
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in specials.items()}
        raw = [tokens.get(i, "").encode() for i in range(max(tokens) + 1)]
        self.offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        self.blob = b"".join(raw)
        self.token = {str(i): x.decode() for i, x in enumerate(raw)}
        self._bytes = {b: self.letters[b] for b in range(256)}
        self._chunks = _Chunks(self)

    def _symbols(self, token: str) -> str:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + self._END)
        return token

    def compatible_as_merge(self, r: int) -> bool:
        """Whether the two parts of merge ``r`` meet in a text made of just them, and nothing is merged across earlier."""
        left, right = self.split[r]
        return self._pair(left, right, r)

    def _pair(self, left: int, right: int, skip: int) -> bool:
        limit = len(self.split)
        a, b = left, right
        while True:
            merged = self.pairs.get((a, b))
            if merged is not None and merged < limit and merged != skip:
                return False
            if a > b:
                limit, a = a, self.split[a][1]
                if a == limit:
                    limit, b = b + 1, self.split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit, a = a, self.split[a][1]
                    if a == limit:
                        return True

    def compatible(self, left: int, right: int) -> bool:
        """The pair table, filled as pairs are met: whether the two tokens stay apart side by side."""
        key = (left, right)
        got = self._valid.get(key)
        if got is None:
            if len(self._valid) > 1_000_000:
                self._valid.clear()
            got = self._valid[key] = self._pair(left, right, -1)
        return got

    def encode_word(self, symbols: str) -> list[int]:
        """Ranks of the tokens of one word (its symbols, the last one marked)."""
        n = len(symbols)
        length, shorter, compatible = self.length, self.shorter, self.compatible
        longest = [-1] * (n + 1)
        for end, r in self.automaton.iter(symbols):  # ends ascend, so the last token that starts somewhere is the longest there
            longest[end - length[r] + 1] = r
        out: list[int] = []
        dead = bytearray(n + 1)
        at, r = 0, longest[0]
        while at < n:
            while r >= 0:
                end = at + length[r]
                if not dead[end] and (not out or compatible(out[-1], r)):
                    break
                r = shorter[r]
            if r >= 0:
                out.append(r)
                at += length[r]
                r = longest[at]
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("a symbol of the word is not in the vocabulary")
                r = out.pop()
                at -= length[r]
        return out

    def forget(self) -> None:
        """Let go of all words and pairs met so far. Both, as they lie between each other in memory, and few pairs that stay would hold all of it."""
        self._chunks.forget()
        self._valid.clear()

    def _encoded_piece(self, piece: str) -> str:
        letters = self._bytes
        symbols = piece if piece.isascii() and piece.isprintable() else "".join([letters[b] for b in piece.encode("utf-8", "surrogatepass")])
        ids = [self.rank_id[r] for r in self.encode_word(symbols[:-1] + chr(ord(symbols[-1]) + self._END))]
        return " ".join(map(str, ids))

    def decode(self, ids) -> str:
        """Tokens of ``ids`` one after another, joined by one space, read from the offset table."""
        blob, at = self.blob, self.offsets
        return b" ".join([blob[at[i] : at[i + 1]] for i in ids]).decode()

    @staticmethod
    def _normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)  # no rule for a final sigma

    def _segment(self, text: str) -> list[str]:
        text = self._normal(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # Python splits there, the vocabulary's white space does not
            return [self._chunks[p] for p in self._piece.findall(text)]
        return [x for x in map(self._chunks.__getitem__, text.split()) if x]

    def encode_text(self, text: str | None) -> tuple[str, str]:
        """(decimal ids joined by one space, decoded text) of a whole text; null counts as empty."""
        if not text:
            return "", ""
        if len(self._chunks) > WORDS_AT_MOST:
            self._chunks.age()
        out: list[str] = []
        if self._special is None or not any(s in text for s in self.specials):
            out = self._segment(text)
        else:
            for part in self._special.split(text):
                if part in self.specials:
                    out.append(str(self.specials[part]))
                elif part:
                    out += self._segment(part)
        ids = " ".join(out)
        return ids, " ".join(map(self.token.__getitem__, ids.split(" "))) if ids else ""

    def encode(self, text: str | None) -> list[int]:
        ids = self.encode_text(text)[0]
        return [int(x) for x in ids.split()]


class _Chunks(dict):
    """Decimal ids of each run of text between white space, filled on demand; two generations bound its size."""

    def __init__(self, bpe: WordBPE):
        super().__init__()
        self.bpe = bpe
        self.old: dict[str, str] = {}

    def age(self) -> None:
        self.old = dict(self)
        self.clear()

    def forget(self) -> None:
        self.old = {}
        self.clear()

    def __missing__(self, chunk: str) -> str:
        got = self.old.get(chunk)
        if got is None:
            bpe = self.bpe
            parts = [chunk] if chunk.isalpha() else bpe._piece.findall(chunk)
            if len(parts) == 1:
                got = bpe._encoded_piece(parts[0])
            else:
                got = " ".join([self[p] for p in parts])
        self[chunk] = got
        return got


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBPE:
    return WordBPE(path)


def encode_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), ids: bool = True, text: bool = False, digests: bool = False) -> DataFrame:
    """Encode every whole text and decode it again; one row per row, no shuffle.

    ``vocabulary`` is the path of a tokenizer file that every executor can
    read. Columns: ``doc_id``, those of ``keep``, ``n_tokens``, then on request
    ``token_ids`` (array of int), ``decoded`` (text), ``ids_sha256`` and
    ``decoded_sha256`` (lower-case hex of the decimal ids joined by one space,
    and of the decoded text in UTF-8).

    A null text counts as empty: no tokens and an empty decoded text. Rows with
    a null id, repeated rows and ties are encoded like any other. Other columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), *[c for c in keep if c != id_col], F.col(text_col).cast("string").alias("_text_in"))
    kept = src.columns[:-1]
    fields = [f for f in src.schema.fields[:-1]]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long"
    ddl += ", token_ids array<int>" * ids + ", decoded string" * text + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches):
        bpe = loaded(vocabulary)
        bpe.forget()  # a worker that is used again starts small
        for batch in batches:
            n, rows, decoded, sha_ids, sha_text = [], [], [], [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                a, b = bpe.encode_text(t)
                n.append(a.count(" ") + 1 if a else 0)
                if ids:
                    rows.append(np.fromstring(a, dtype=np.int32, sep=" ") if a else np.zeros(0, dtype=np.int32))
                if text:
                    decoded.append(b)
                if digests:
                    sha_ids.append(hashlib.sha256(a.encode()).hexdigest())
                    sha_text.append(hashlib.sha256(b.encode()).hexdigest())
            out, names = [batch.column(i) for i in range(len(kept))] + [pa.array(n, pa.int64())], [*kept, "n_tokens"]
            if ids:
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in rows]))), pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))
                out.append(lists)
                names.append("token_ids")
            if text:
                out.append(pa.array(decoded, pa.string()))
                names.append("decoded")
            if digests:
                out += [pa.array(sha_ids, pa.string()), pa.array(sha_text, pa.string())]
                names += ["ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(out, names=names)
        bpe.forget()

    return src.mapInArrow(tidy(run, 500), ddl)


def decode_ids(encoded: DataFrame, vocabulary: str, *, ids_col: str = "token_ids") -> DataFrame:
    """Add ``decoded``: the text of each row's token ids (null for null ids)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def decoded(col):
        bpe = loaded(vocabulary)
        return col.map(lambda x: None if x is None else bpe.decode(x))

    return encoded.withColumn("decoded", decoded(ids_col))
