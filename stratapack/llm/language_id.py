"""Language identification by a byte convolutional network.

Bytes are embedded; filters of several widths run over windows of fixed length; each filter's maximum over a window, after
a ReLU, feeds a softmax.  The network is trained in numpy with Adam on a bounded sample of labelled windows.  A text is cut
into windows from end to end, and its prediction is the mean of all its windows' probabilities, weighted by their bytes.

For prediction a filter is a sum of table rows, one for each byte or pair of bytes, so no matrix product is needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import chunks, table, text_buffers

LENGTH = 256
WIDTHS = (2, 3, 4)
UNKNOWN = "und"
#: Training takes about so many windows in all, the same number from each language, and no more.
MAX_WINDOWS = 8000
#: Small samples are gone through more often, so that training takes so many steps at least.
LEAST_STEPS = 300


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows of LENGTH bytes, the last of a text filled up with 0; the text of each; its bytes)."""
    size = np.diff(offsets)
    n = -(-size // LENGTH)
    base = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(base[-1] * LENGTH, np.uint8)
    out[np.arange(len(data)) + np.repeat(base[:-1] * LENGTH - offsets[:-1], size)] = data
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(base[-1]) - base[:-1][text]
    return out.reshape(-1, LENGTH), text, np.minimum(LENGTH, size[text] - place * LENGTH)


class ByteCnn:
    """The network: embedding E, filters W[w] with bias B[w], and the softmax layer V, C."""

    def __init__(self, langs: list[str], filters: int = 16, dim: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"E": rng.normal(0, 0.5, (256, dim)), "V": rng.normal(0, 0.1, (filters * len(WIDTHS), len(langs))), "C": np.zeros(len(langs))}
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, (w * dim) ** -0.5, (w * dim, filters))
            self.p[f"B{w}"] = np.zeros(filters)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> ByteCnn:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(max(epochs, -(-LEAST_STEPS * batch // len(x)))):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                step += 1
                for k, g in self._gradients(x[order[a : a + batch]], y[order[a : a + batch]]).items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.001 * (g * g - s[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        dim = p["E"].shape[1]
        e = p["E"][x]
        pooled, where = [], []
        for w in WIDTHS:
            span = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, LENGTH - w + 1, w * dim)
            z = span @ p[f"W{w}"] + p[f"B{w}"]
            where.append(z.argmax(1))
            pooled.append(np.take_along_axis(z, where[-1][:, None], 1)[:, 0])
        z = np.concatenate(pooled, 1)
        hidden = np.maximum(z, 0)
        prob = _softmax(hidden @ p["V"] + p["C"])
        prob[np.arange(n), y] -= 1
        prob /= n
        g = {"V": hidden.T @ prob, "C": prob.sum(0), "E": np.zeros_like(p["E"])}
        back = (prob @ p["V"].T) * (z > 0)
        filters = p["B2"].shape[0]
        for k, w in enumerate(WIDTHS):
            d = back[:, k * filters : (k + 1) * filters]
            at = where[k][:, :, None] + np.arange(w)  # only the maximum of a filter passes gradient on
            used = x[np.arange(n)[:, None, None], at]
            g[f"W{w}"] = np.einsum("nfd,nf->df", p["E"][used].reshape(n, filters, w * dim), d, optimize=True)
            g[f"B{w}"] = d.sum(0)
            np.add.at(g["E"], used, d[:, :, None, None] * p[f"W{w}"].T.reshape(1, filters, w, dim))
        return g

    def tables(self) -> None:
        """Filter outputs by byte pair (or byte), for prediction."""
        dim = self.p["E"].shape[1]
        one = {(w, o): self.p["E"] @ self.p[f"W{w}"][o * dim : (o + 1) * dim] for w in WIDTHS for o in range(w)}
        pair = lambda w, o: (one[w, o][:, None] + one[w, o + 1][None]).reshape(65536, -1)
        self.parts = {w: [pair(w, o) if o + 1 < w else one[w, o] for o in range(0, w, 2)] for w in WIDTHS}

    def predict(self, x: np.ndarray, tile: int = 128) -> np.ndarray:
        """Probabilities of the languages for each window."""
        out = np.empty((len(x), len(self.langs)), np.float32)
        for a in range(0, len(x), tile):
            part = x[a : a + tile]
            two = (part[:, :-1].astype(np.int32) << 8) | part[:, 1:]
            pooled = []
            for w in WIDTHS:
                n = LENGTH - w + 1
                z = None
                for k, t in enumerate(self.parts[w]):
                    at = two[:, 2 * k : 2 * k + n] if len(t) == 65536 else part[:, 2 * k : 2 * k + n]
                    z = t.take(at, axis=0) if z is None else np.add(z, t.take(at, axis=0), out=z)
                while z.shape[1] > 1:  # pool by halves
                    half = z.shape[1] // 2
                    rest = z[:, 2 * half :]
                    z = np.maximum(z[:, :half], z[:, half : 2 * half])
                    if rest.shape[1]:
                        z[:, :1] = np.maximum(z[:, :1], rest)
                pooled.append(z[:, 0] + self.p[f"B{w}"])
            out[a : a + tile] = _softmax(np.maximum(np.concatenate(pooled, 1), 0) @ self.p["V"] + self.p["C"])
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_windows: int = MAX_WINDOWS) -> ByteCnn | None:
    """Fits the network on at most about `max_windows` windows: two places of each sampled text, chosen by hashes of the id.

    Rows without text, with an empty text or without lang are left out.  Languages are sampled at their own rates, so that each gives as many
    rows.  None if there is nothing to learn from.
    """
    rows = labelled.where(F.col(lang).isNotNull() & (F.length(text) > 0))
    counts = sorted(tuple(r) for r in rows.groupBy(lang).count().collect())
    if not counts:
        return None
    want = max_windows / 2 / len(counts)
    rates = F.create_map(*[F.lit(v) for x, n in counts for v in (x, min(1.0, want / n))])
    unit = lambda *key: F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / (1 << 30)
    place = lambda k: F.substring(text, (unit(F.col(doc_id), F.lit(k)) * F.greatest(F.length(text) - 180, F.lit(1))).cast("int") + 1, F.lit(LENGTH))
    got = rows.where(unit(F.col(doc_id)) < rates[F.col(lang)]).select(lang, place(1).alias("a"), place(2).alias("b")).collect()
    langs = [x for x, _ in counts]
    number = {x: k for k, x in enumerate(langs)}
    pairs = sorted((t.encode()[:LENGTH], number[r[0]]) for r in got for t in (r.a, r.b))
    x = np.zeros((len(pairs), LENGTH), np.uint8)
    for k, (t, _) in enumerate(pairs):
        x[k, : len(t)] = np.frombuffer(t, np.uint8)
    model = ByteCnn(langs).fit(x, np.array([y for _, y in pairs]))
    model.tables()
    return model


def identify(docs: DataFrame, model: ByteCnn | None, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score, from every window of the whole text.

    lang_pred is one of the model's languages, or 'und' with score 0 where the text is null or has no letter (also where there
    is no model).  Very long texts are read whole.  Equal texts get equal results; of equal probabilities the first language in the model's order wins.  Input columns named
    lang_pred or score are replaced.  An empty table gives an empty table.
    """
    docs = docs.drop("lang_pred", "score")
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # weights and tables: a few MB, whatever the input
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def scan(batches):
        net = shipped.value
        for batch in batches:
            for chunk in chunks(batch, text):
                known = pc.fill_null(pc.match_substring_regex(chunk.column(text), r"\p{L}"), False).to_numpy(zero_copy_only=False)
                pred, score = np.full(len(chunk), UNKNOWN, object), np.zeros(len(chunk))
                if net is not None:
                    x, owner, size = windows(*text_buffers(chunk.column(text)))
                    prob = net.predict(x)
                    total = np.stack([np.bincount(owner, prob[:, k] * size, minlength=len(chunk)) for k in range(len(net.langs))], 1).astype(float)
                    total /= np.maximum(np.bincount(owner, size, minlength=len(chunk)), 1)[:, None]
                    best = total.argmax(1)
                    pred[known] = np.array(net.langs, object)[best[known]]
                    score[known] = np.clip(total[np.arange(len(chunk)), best], 0, 1)[known]
                yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(pred.tolist(), pa.string()), pa.array(score)], schema=arrow)

    return docs.mapInArrow(scan, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text has remainder 1 modulo 3; a null id counts as ''."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
