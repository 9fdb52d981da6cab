"""Personal data: base patterns, and spans that a linear-chain conditional random field over word shapes adds.

Base kinds are email, ip, card and phone, each leftmost and non-overlapping; a match that fails its test is dropped and not
retried. The field is trained from the small labelled table below and tags the tokens of every line, decoded by Viterbi in
numpy batches. Its spans of the kinds `secret` (keys, tokens, passwords, with their separators), `phone_local` (numbers without a
country code) and `national_id` are added where they touch no base span. Its labels of the base kinds only serve as
contrast: the patterns alone decide on those kinds.

Offsets are code points, ends exclusive. A null text counts as empty and has no span. Rows that share a doc_id are
searched apart. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts
from .crf import train

BASE = ("email", "ip", "card", "phone")
#: Kinds that only the field finds.
ADDED = ("secret", "phone_local", "national_id")
KINDS = (*BASE, *ADDED)
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_WORD, _MARKED, _HEX = r"^\p{Lu}?\p{Ll}+$", r"[.,;:!?]$", r"^[a-fA-F]{13,}$"
#: Distances from a token to those whose features speak of it.
AROUND = (-3, -2, -1, 0, 1, 2, 3)
#: Tokens whose scores are held at once (a longer line is one block), and rows that a worker reads at once.
TOKENS, ROWS = 300_000, 1000

#: Labelled sentences: {kind:span}. Slots in angle brackets are filled by `_fill`, each sentence VARIANTS times.
LABELLED = (
    "token = \"{secret:<hex40>}\"", "the token = \"{secret:<hex40>}\" is old", "password={secret:<hex18>}", "the key {secret:<akia>} was", "<lower12> token = \"{secret:<hex40>}\" <lower8>", "<lower6>, <lower18> token = \"{secret:<hex40>}\"\u0020<lower4>", "<lower15> {secret:<akia>} <lower10>,", "{secret:<akia>}", "<lower4> <lower8> <lower9> {secret:<akia>} to <lower8>", "<lower6>, the <lower10> {secret:<akia>} <lower6> an", "<Lower6> <lower9>, <lower12> {secret:<akia>} <lower3>, <lower4>", "<lower5>, {secret:<akia>} <lower5>, <lower8>", "api_key = \"{secret:<mixed32>}\"", "we lost {secret:<akia>}. Then it", "von {secret:<akia>} und", "un {secret:<akia>}, qui",
    "secret: {secret:<mixed24>}", "and password={secret:<hex18>} for the", "de {secret:<akia>} de la", "Authorization: Bearer {secret:<mixed32>}", "Authorization: Bearer {secret:eyJ<mixed20>.eyJ<mixed40>.<mixed32>}", "Bearer {secret:eyJ<mixed33>.eyJ<mixed20>-<mixed9>.<mixed9>_<mixed24>} was sent",
    "passwd: {secret:<mixed16>}", "client_secret={secret:<mixed32>}, and", "pwd={secret:<hex18>}", "access token {secret:<hex40>} expires", "TOKEN = \"{secret:<HEX40>}\"", "PASSWORD={secret:<HEX18>}!! THE", "{secret:eyJ<mixed20>.eyJ<mixed40>.<mixed32>}",
    "{secret:ghp_<mixed36>}", "the token {secret:ghp_<mixed36>} is", "GITHUB_TOKEN={secret:ghp_<mixed36>}", "use {secret:gho_<mixed36>} here", "{secret:github_pat_<mixed22>_<mixed59>}", "key {secret:sk-<mixed48>} and", "{secret:sk-proj-<mixed20>-<mixed20>}", "{secret:sk-proj-<mixed20>_<mixed9>}", "OPENAI_API_KEY={secret:sk-proj-<mixed48>}", "{secret:sk_live_<mixed24>}", "{secret:pk_test_<mixed24>}", "{secret:xoxb-<n12>-<mixed24>}", "{secret:glpat-<mixed20>}",
    "aws_secret_access_key = {secret:<mixed16>/<mixed9>+<mixed13>}", "aws_secret_access_key = {secret:<mixed13>/<mixed7>/<mixed18>}", "{secret:<mixed13>/<mixed7>/<mixed18>}", "aws_secret_access_key={secret:<mixed20>/<mixed19>}", "AWS_SECRET_ACCESS_KEY = {secret:<mixed9>+<mixed9>/<mixed20>}", "secret_key: \"{secret:<mixed13>/<mixed13>/<mixed12>}\"", "aws_access_key_id = {secret:<akia>}",
    "password: {secret:<lower9>}", "password = \"{secret:<lower6>}\"", "password: {secret:<lower6>-<lower6>-<lower5>}", "passphrase: {secret:<lower6>-<lower5>-<lower6>-<lower5>}", "my password is {secret:<mixed9>}", "the password is {secret:<lower6><n2>} now", "passphrase = \"{secret:<lower6> <lower5> <lower6> <lower5>}\"", "password={secret:<lower6>_<n2>}", "pwd: {secret:<mixed6>!<mixed4>}", "passwd = '{secret:<mixed6>-<mixed6>}'",
    "mail {email:<user>@<host>.com} now", "{email:<user>.<n2>@<host>.example.com}", "write to {email:<user>.<n2>@mail<n1>.example.com} and on", "the {email:<user>@<host>.org}, again", "contact: {email:<user>_<n2>@<host>.co.uk}.",
    "from {ip:<oct>.<oct>.<oct>.<oct>} on", "{ip:<oct>.<oct>.<oct>.<oct>}", "host {ip:<oct>.<oct>.<oct>.<oct>} port 8080", "en {ip:<oct>.<oct>.<oct>.<oct>}, un",
    "card {card:<n16>} was", "{card:<n16>}", "pay {card:<n4> <n4> <n4> <n4>} by", "again. {card:<n16>} The", "visa {card:<n4>-<n4>-<n4>-<n4>}.",
    "call {phone:+<n1> (<n3>) <n3>-<n4>} now", "{phone:+<n1> (<n3>) <n3>-<n4>}", "in {phone:+<n2> <n3> <n3> <n4>} or", "tel {phone:+<n1>-<n3>-<n3>-<n4>}.",
    "call {phone_local:(<n3>) <n3>-<n4>} now", "phone: {phone_local:<n3>-<n3>-<n4>}", "tel. {phone_local:(<n3>) <n3>-<n4>}, or", "reach me at {phone_local:<n3>-<n3>-<n4>}.", "phone {phone_local:<n3>.<n3>.<n4>} or",
    "{national_id:<n3>-<n2>-<n4>}", "ssn {national_id:<n3>-<n2>-<n4>} was", "SSN: {national_id:<n3>-<n2>-<n4>}", "his number is {national_id:<n3>-<n2>-<n4>}, and",
    "Licensed under CC BY-NC 4.0.", "the GNU General Public License, version 3.", "Apache License, Version 2.0", "in 19<n2> and 20<n2> the", "20<n2>-0<n1>-<n2>", "page <n3> of <n4>", "<n1>,<n3>,<n3> people", "about <n2>.<n1> % of",
    "chapter <n2>.", "for $<n3>.<n2> each", "<n2>:<n2>:<n2>", "isbn <n3>-<n1>-<n2>-<n4>-<n1>", "order <n4> and line <n2>", "see section <n1>.<n1>.<n1>.", "the 1st, 2nd and <n2>th", "a<n1>b and x<n2>", "v<n1>.<n2>.<n1>", "<n2>/<n2>/20<n2>", "20<n2>-0<n1>-<n2>T<n2>:<n2>:<n2>Z",
    "utf8 and sha256 or md5", "<n4> words in <n3> lines", "@ the end of <n4>", "a follow of @<user> here", "matrix <n2>x<n2>", "room B<n3>", "RFC <n4>", "between <n3> and <n3>-<n4>", "score <n1>-<n1>", "+ <n2> or - <n2>", "commit <hex8> fixes", "<lower9> <n16> <lower4>", "number <n14> of <n12>", "<lower3> <n18> and", "uuid <hex8> is short", "covid19 or windows10 were",
    "the secret of a long life is simple", "a token of our thanks", "the key to the house was lost", "forgot your password?", "your password must be changed every year", "the password field is empty", "access to the park is free", "a client asked for the card", "the bearer of this letter", "passwords and keys are stored apart", "a state-of-the-art, well-known part-time job", "self.assertEqual(value, other_value)", "def get_user_name(user_id):", "int main(void) { return 0; }", "import os.path as path_of", "README.md and setup.py", "https://www.example.com/path/to/page", "/usr/local/bin/python", "and/or, either/or",
    "The weather was fine and we walked along the river until evening.", "She read the book twice; it was better than the film.", "Nobody knows why the ship left so early, but it did.", "Le chat dort sur la table, et la pluie tombe encore.", "Nous avons mangé du pain et du fromage.", "C'est l'été, qu'il fait beau aujourd'hui!", "Der Zug fährt heute nicht, weil es schneit.", "Die Kinder spielen im Garten und lachen.", "El perro corre por la calle y no vuelve.", "La casa está cerca del mar, según dicen.",
    "Internationalisation and misunderstanding are long words.", "ANOTHER LINE IN CAPITALS, FOR THE RECORD", "NASA and UNESCO met in Geneva.", "iPhone, eBay and YouTube are names", "McDonald and O'Neill", "||||", "- one, - two, - three", "...", "wait!!! what??? no$$$ yes&&& <lower9>*** <lower4>%%% <lower15>### the+++", "<lower6>&&& <lower18>### <lower2>%%% <lower14>$$$", "<lower15>.&&& <Lower16>*** <lower4>### a$$$", "in %%% of ### and $$$ or *** to &&&", "<lower3>$$$ <lower3>&&& <lower15>&&& <lower2>", "<lower15> <lower18>, <lower22>.", "the <lower16> and <lower20>", "<lower16> <lower5>é<lower9> <lower8>ñ<lower8>", "<Lower15> <Lower20>. <lower15>", "<lower9> | <lower22>. | <Lower6>", "| <lower15> | <lower18> |", "<Upper15>!! <Upper4> <Upper20>!! <Upper2>!!", "<Upper22>.", "* * *", "<lower9> <lower6> <lower12>, <lower5>.", "<lower12><lower6> and <lower9><lower9>.", "<Lower9> <lower3> <lower12>! <lower5>?", "<lower5>; <lower6>: <lower9>", "<lower9>\u2019<lower3> \u2014 <lower6>",
)
VARIANTS = 9
_CUES = frozenset("token password passwd pwd passphrase secret key keys id access api aws github openai bearer authorization client ghp gho glpat pat sk pk proj live test xoxb mail email call phone tel telephone fax reach contact card visa pay ip host version license page section chapter isbn order rfc commit uuid akia ssn number is".split())

_CUE_ARRAY = pa.array(sorted(_CUES), pa.large_string())


def _fill(sentence: str, rng: np.random.Generator) -> str:
    def digits(n: int) -> str:
        return "".join(str(x) for x in rng.integers(0, 10, n))

    def of(chars: str, n: int) -> str:
        return "".join(chars[k] for k in rng.integers(0, len(chars), n))

    def slot(m: re.Match) -> str:
        name, n = m[1].rstrip("0123456789"), int(re.sub(r"\D", "", m[1]) or 0)
        low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        if name == "n":
            return digits(n)
        if name == "mixed" and n >= 4:  # keys have letters of both cases and digits
            return of(low, 1) + of(low + up + "0123456789", n - 3) + of("0123456789", 1) + of(up, 1)
        return {"hex": lambda: of("0123456789abcdef", n), "HEX": lambda: of("0123456789ABCDEF", n), "akia": lambda: "AKIA" + of(up + "234567", 16), "mixed": lambda: of(low + up + "0123456789", n), "lower": lambda: of(low, n), "Lower": lambda: of(low, n).capitalize(), "Upper": lambda: of(up, n), "user": lambda: of(low, int(rng.integers(3, 9))), "host": lambda: of(low, int(rng.integers(3, 8))), "oct": lambda: str(rng.integers(1, 256))}[name]()

    return re.sub(r"<(\w+)>", slot, sentence)


def labelled_table(variants: int = VARIANTS) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with their (start, end, kind), the same each time."""
    rng, out = np.random.default_rng(11), []
    for sentence in LABELLED * variants:
        text, spans, rest = "", [], _fill(sentence, rng)
        for part in re.split(r"(\{\w+:[^}]*\})", rest):
            if m := re.fullmatch(r"\{(\w+):([^}]*)\}", part):
                spans.append((len(text), len(text) + len(m[2]), m[1]))
                text += m[2]
            else:
                text += part
        out.append((text, spans))
    return out


def shape(token: str) -> str:
    """Classes of characters with repeats as one, and a length class."""
    if token.isalpha() and token.islower():
        return "x/" + str(min(len(token).bit_length(), 6))
    kinds = re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", re.sub(r"\d", "9", token))
    runs = re.sub(r"(.)\1+", r"\1", kinds)
    return (runs if len(runs) <= 4 else "*" + "".join(sorted(set(runs)))) + "/" + str(min(len(token).bit_length(), 6))


def _token_features(token: str) -> tuple[str, ...]:
    out = [shape(token)]
    if token.lower() in _CUES:
        out.append("w" + token.lower())
    if token.isdigit():
        out.append(f"n{min(len(token), 20)}")
    elif len(token) > 12 or not token.isalpha() and any(c.isdigit() for c in token):
        out.append("hex" if re.fullmatch("[0-9a-fA-F]+", token) else "mix")
        out.append(f"l{len(token) // 4}")
        if len(token) >= 16 and token.upper() == token and not token.isdigit():
            out += ["key", "key" + token[:4] if token[:4] in ("AKIA", "ASIA") else "key?"]
        if token.startswith("eyJ"):
            out.append("json")
    return tuple(out)


class Tagger:
    """Weights by feature; labels are O, then B and I of each kind.

    Tokens with the same features share a row of scores, in one table for each distance to the token that they speak of. most: runs
    remembered before a batch (a few hundred bytes each).
    """

    def __init__(self, most: int = 100_000):
        table = labelled_table()
        names: dict[str, int] = {}
        flat, ends, labels, sizes = [], [0], [], []
        for text, spans in table:
            tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
            own = [_token_features(t) for *_, t in tokens]
            for k in range(len(own)):
                for d in AROUND:
                    found = own[k + d] if 0 <= k + d < len(own) else ("edge",)
                    flat += [names.setdefault(f"{d}:{x}", len(names)) for x in found]
                ends.append(len(flat))
            labels += [next((1 + 2 * KINDS.index(k) + (s > a) for a, b, k in spans if a <= s < b), 0) for s, *_ in tokens]
            sizes.append(len(tokens))
        n = len(labels)
        self.crf = train(np.array(flat), np.array(ends), np.arange(n), np.array(labels), np.array(sizes), len(names), 1 + 2 * len(KINDS), steps=80, rate=0.3, l2=0.05)
        for k in range(len(KINDS)):  # an inside label follows only its own kind
            self.crf.first[2 + 2 * k] = -1e4
            for a in range(1 + 2 * len(KINDS)):
                if a not in (1 + 2 * k, 2 + 2 * k):
                    self.crf.moves[a, 2 + 2 * k] = -1e4
        self.names, self.most = names, most
        self.sets: dict[tuple[str, ...], int] = {}
        self.rows = np.zeros((len(AROUND), 1024, self.crf.emission.shape[1]), np.float32)
        self._row(("edge",))
        #: Rows of plain words by length, of small letters and with a capital first.
        self.plain = np.array([[0, *(self._row(_token_features(x + "g" * (n - 1))) for n in range(1, 64))] for x in "gG"])
        self._forget()

    def _forget(self) -> None:
        self.pieces: dict[str, tuple[list[int], list[int], list[int]]] = {}
        self.numbers: dict[str, int] = {}

    def _row(self, features: tuple[str, ...]) -> int:
        """The row of these features in the tables of scores."""
        at = self.sets.get(features)
        if at is None:
            at = self.sets[features] = len(self.sets)
            if at >= self.rows.shape[1]:
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)], axis=1)
            for k, d in enumerate(AROUND):
                known = [n for x in features if (n := self.names.get(f"{d}:{x}")) is not None]
                self.rows[k, at] = self.crf.emission[known].sum(0)
        return at

    def _number(self, token: str) -> int:
        at = self.numbers.get(token)
        if at is None:
            at = self.numbers[token] = self._row(_token_features(token))
        return at

    def _piece(self, piece: str) -> tuple[list[int], list[int], list[int]]:
        """Rows, starts and ends of the tokens of a run without spaces."""
        found = self.pieces.get(piece)
        if found is None:
            n = len(piece)
            if piece.isalnum():
                found = [self._number(piece)], [0], [n]
            elif piece[:-1].isalnum() and not piece[-1].isspace():
                found = [self._number(piece[:-1]), self._number(piece[-1])], [0, n - 1], [n - 1, n]
            else:
                tokens = list(_TOKEN.finditer(piece))
                found = [self._number(m[0]) for m in tokens], [m.start() for m in tokens], [m.end() for m in tokens]
            self.pieces[piece] = found
        return found

    def _words(self, pieces: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        """How many tokens each distinct run has, and rows, starts and ends of all of them, one run after another.

        All words of small letters, perhaps with a capital first and one mark last, have the same features as any other of that length,
        but for cues and for long ones that could be hexadecimal. They are found and filled in as arrays.
        """
        size = pc.utf8_length(pieces).to_numpy().astype(np.int64)
        marked = pc.match_substring_regex(pieces, _MARKED).to_numpy(zero_copy_only=False)
        word = pc.utf8_slice_codeunits(pieces, 0, -1) if marked.all() and len(pieces) else pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(pieces, 0, -1), pieces)
        plain = pc.match_substring_regex(word, _WORD).to_numpy(zero_copy_only=False) & ~pc.match_substring_regex(word, _HEX).to_numpy(zero_copy_only=False)
        plain &= ~pc.is_in(pc.utf8_lower(word), value_set=_CUE_ARRAY).to_numpy(zero_copy_only=False) & (size < len(self.plain[0]))
        title = pc.match_substring_regex(word, r"^\p{Lu}").to_numpy(zero_copy_only=False)
        if len(self.pieces) > self.most:
            self._forget()
        slow = np.flatnonzero(~plain)
        known = [self._piece(x) for x in pieces.take(pa.array(slow)).to_pylist()]
        own = 1 + (plain & marked).astype(np.int64)
        own[slow] = [len(x[0]) for x in known]
        begun = np.cumsum(own) - own
        out = [np.zeros(int(own.sum()), np.int64) for _ in range(3)]
        length = size - marked
        at = begun[plain]
        out[0][at], out[2][at] = self.plain[title[plain].astype(int), length[plain]], length[plain]
        both = np.flatnonzero(plain & marked)
        if len(both):
            at = begun[both] + 1
            marks = pc.utf8_slice_codeunits(pieces.take(pa.array(both)), -1).dictionary_encode()
            out[0][at] = np.array([self._number(x) for x in marks.dictionary.to_pylist()], np.int64)[marks.indices.to_numpy()]
            out[1][at], out[2][at] = length[both], size[both]
        n = own[slow]
        at = np.repeat(begun[slow] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        for k in range(3):
            out[k][at] = np.fromiter(itertools.chain.from_iterable(x[k] for x in known), np.int64, int(n.sum()))
        return own, out

    def tag(self, texts: pa.Array) -> list[list[tuple[int, int, str]]]:
        """Spans of each text. Its lines are the sequences; runs without spaces are cut into tokens once."""
        lines = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
        split = pc.split_pattern(lines.flatten(), " ")
        words = split.flatten()
        coded = words.dictionary_encode()
        own, tokens = self._words(coded.dictionary)
        begun = np.cumsum(own) - own
        code = coded.indices.to_numpy().astype(np.int64)
        width = pc.utf8_length(words).to_numpy().astype(np.int64) + 1
        word_at = np.cumsum(width) - width
        of_line, of_text = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (split, lines))
        line_word = np.concatenate([[0], np.cumsum(of_line)])
        text_line = np.concatenate([[0], np.cumsum(of_text)])
        text_word = line_word[text_line[:-1]]
        out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(texts))]
        done = np.concatenate([[0], np.cumsum(own[code])])[line_word]  # tokens before each line
        a = 0
        while a < len(of_line):
            b = max(a + 1, int(np.searchsorted(done, done[a] + TOKENS, side="right")) - 1)
            part = np.arange(line_word[a], line_word[b])
            n = own[code[part]]
            word = np.repeat(part, n)
            token = np.repeat(begun[code[part]], n) + np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
            sizes = np.diff(done[a : b + 1])
            labels = self._decoded(self._scores(tokens[0][token], sizes), sizes)
            heads = np.flatnonzero(labels % 2 == 1)
            if len(heads):
                line = np.repeat(np.arange(a, b), sizes)
                inside = (labels > 0) & (labels % 2 == 0)
                stops = np.flatnonzero(~inside)
                last = np.append(stops, len(labels))[np.searchsorted(stops, heads, side="right")] - 1
                for h, z in zip(heads.tolist(), last.tolist(), strict=True):
                    text = int(np.searchsorted(text_line, line[h], side="right")) - 1
                    base = word_at[text_word[text]]
                    out[text].append((int(word_at[word[h]] - base + tokens[1][token[h]]), int(word_at[word[z]] - base + tokens[2][token[z]]), KINDS[(int(labels[h]) - 1) // 2]))
            a = b
        return out

    def _decoded(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Viterbi labels, decoded only where a label other than O is possible.

        A path that leaves O for m places in a row gains by its moves at most `enter` + (m - 1) * `inside` + `leave` over O all along, and loses by
        its scores what O leads by there. So a place that lies in no run whose lead is as small as that has label O on the best path, and the
        stretches between such places are decoded apart, with O before and after them.
        """
        moves, first = self.crf.moves.astype(np.float32), self.crf.first.astype(np.float32)
        enter = max(float(moves[0, 1:].max() - moves[0, 0]), float(first[1:].max() - first[0]))
        inside = float(moves[1:, 1:].max() - moves[0, 0])
        leave = max(0.0, float(moves[1:, 0].max() - moves[0, 0]))
        out = np.zeros(len(scores), np.int16)
        if not len(scores):
            return out
        lead = (scores[:, 0] - scores[:, 1:].max(1)).astype(float) - inside
        # the least sum of a run through each place: of those that end here and of those that begin after it
        line = np.repeat(np.arange(len(sizes)), sizes)
        total = np.cumsum(lead)
        before = total - lead
        far = float(np.abs(lead).sum()) + 1.0  # sets lines so far apart that no run spans two
        behind = total - (np.maximum.accumulate(before + far * line) - far * line)
        ahead = np.minimum.accumulate((total + far * line)[::-1])[::-1] - far * line - total
        free = behind + ahead <= enter + leave - inside + 1e-3
        at = np.flatnonzero(free)
        if not len(at):
            return out
        heads = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(line[at]) > 0)])
        tails = np.append(heads[1:], True)
        some = scores[at].astype(float)
        starts = np.cumsum(sizes) - sizes
        led = heads & (at > starts[line[at]])
        some[led] += moves[0] - first
        ended = tails & (at + 1 < (starts + sizes)[line[at]])
        some[ended] += moves[:, 0]
        out[at] = self.crf.viterbi(some, np.diff(np.append(np.flatnonzero(heads), len(at))))
        return out

    def _scores(self, numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Emission scores: each token's row for its own place and its neighbours' rows for theirs, with edges between the lines."""
        gap = max(AROUND)
        line = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(numbers)) + gap * (line + 1)
        padded = np.zeros(len(numbers) + gap * (len(sizes) + 1), np.int64)
        padded[at] = numbers
        out = np.zeros((len(numbers), self.rows.shape[2]), np.float32)
        for k, d in enumerate(AROUND):
            out += self.rows[k][padded[at + d]]
        return out


_TAGGER: list[Tagger] = []


def tagger() -> Tagger:
    """Trained once in a process, always to the same weights; workers get the driver's."""
    if not _TAGGER:
        _TAGGER.append(Tagger())
    return _TAGGER[0]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """By start, then kind as listed. Each pattern starts at the first place where it can, so long runs cost no more than their length."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end(), "email"))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def find(texts: list[str | None] | pa.Array) -> list[tuple[list, list]]:
    """Base spans of each text, and those that the field adds: of its own kinds, where they touch no base span."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    out = []
    for text, tagged in zip(texts.to_pylist(), tagger().tag(texts), strict=True):
        base = base_spans(text or "")
        starts = [s for s, *_ in base]
        reach = list(itertools.accumulate((e for _, e, _ in base), max))
        # of the base spans that start before the end of a tagged one, none may end after its start
        free = [x for x in tagged if x[2] in ADDED and ((k := bisect.bisect_left(starts, x[1])) == 0 or reach[k - 1] <= x[0])]
        out.append((base, free))
    return out


def merged(base: list, added: list) -> list[tuple[int, int, str, bool]]:
    """All spans by start, then kind; the last field marks base spans."""
    return sorted([(*x, True) for x in base] + [(*x, False) for x in added], key=lambda y: (y[0], KINDS.index(y[2])))


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, found: array of (start, finish, kind, base), where base marks spans of the base patterns."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(tagger())
    item = pa.struct([("start", pa.int64()), ("finish", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _TAGGER:
            _TAGGER.append(sent.value)
        for batch in parts(batches, ROWS):
            rows = [[{"start": s, "finish": e, "kind": k, "base": b} for s, e, k, b in merged(*x)] for x in find(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], [id_col, "found"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(search, f"`{id_col}` {kind}, found array<struct<start: bigint, finish: bigint, kind: string, base: boolean>>")


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, sha256 of the base spans and all spans as text, from what find_pii returns."""
    base = F.filter("found", lambda x: x["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["finish"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return found.select(id_col, *counts, F.size("found").cast("long").alias("n_spans"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def redact(text: str | None, mark: str = "[{}]") -> str | None:
    """The text with each span replaced by its kind."""
    if text is None:
        return None
    out, at = "", 0
    for start, end, kind, _ in merged(*find([text])[0]):
        if start >= at:
            out += text[at:start] + mark.format(kind.upper())
            at = end
    return out + text[at:]


def digest_of(text: str | None) -> tuple[int, int, int, int, str, str]:
    """The digest of one text, for tests."""
    base, added = find([text])[0]
    return (*(sum(k == kind for *_, k in base) for kind in BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined([x[:3] for x in merged(base, added)]))
