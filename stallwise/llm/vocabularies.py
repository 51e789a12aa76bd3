"""Public tokeniser vocabularies, read on the driver from a path that is a parameter, and sent to tasks as bytes.

A vocabulary has under 100,000 entries (a few MB), whatever the corpus is.
"""

from __future__ import annotations

import base64
import os

#: Folder of the vocabulary files unless a call names another.
FOLDER = "/opt/tokenizers"
PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.tiktoken"
MARK = "▁"


def read(name: str, folder: str = FOLDER) -> bytes:
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


class PieceEncoder:
    """Pieces of words by a vocabulary with byte fallback."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.model.get_piece_size()
        self.is_byte = [self.model.is_byte(i) or self.model.is_unknown(i) for i in range(self.size)]

    def words(self, words: list[str]) -> list[list[int]]:
        return self.model.encode(words, num_threads=1)


class ByteEncoder:
    """Tokens of words by a byte-level vocabulary; a word is encoded as it stands after a space."""

    def __init__(self, ranks: bytes) -> None:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        table = {base64.b64decode(token): int(rank) for token, rank in pairs}
        # words hold no white space, so a word is one run for the encoder, cut where letters, digits and signs meet
        pattern = r" ?[^\W\d_]+| ?\d+| ?[^\s\w]+| ?_+|\s+"
        self.model = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def count(self, word: str) -> int:
        return len(self.model.encode_ordinary(" " + word))


def pieces(model: bytes) -> list[str]:
    """The strings of a piece vocabulary, without control, unknown and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
