"""Pre-tokens and ids of the byte-level BPE vocabulary that a tokenizer JSON file holds."""

from __future__ import annotations

import json

import regex


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in such files: itself if printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ranks and special tokens of a tokenizer JSON file of kind byte-level BPE without a normaliser."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        if whole["model"]["type"] != "BPE" or whole["normalizer"] or whole["pre_tokenizer"]["type"] != "ByteLevel" or whole["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        self.special = {x["content"]: x["id"] for x in whole["added_tokens"]}
        letters = byte_alphabet()
        self.ranks = {bytes(letters[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token not in self.special}

    def encoding(self, pattern: str):
        """A tiktoken encoding with the same ids; special tokens' strings in texts become their ids."""
        import tiktoken

        return tiktoken.Encoding("from-json", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens=self.special)


class PreTokens:
    """Splits a text into pre-tokens; special tokens' strings are cut out first and counted apart."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.find = regex.compile(pattern).findall
        self.special = list(vocabulary.special)
        self.cut = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None

    def __call__(self, text: str) -> tuple[list[str], int]:
        if not self.cut or not any(s in text for s in self.special):
            return self.find(text), 0
        parts = self.cut.split(text)
        return [piece for part in parts for piece in self.find(part)], len(parts) - 1
