"""Embedded images: extraction against a plain loop, and a store that holds each content once."""

import base64
import hashlib
import random
import re

from docloom.plans import page_plans
from docloom.sources import images as I


def plain(text):
    found = []

    def put(m):
        try:
            head, data = m[2].split(",", 1)
            raw = base64.b64decode(data, validate=True)
        except ValueError:
            return m[0]
        found.append((head.split("/")[1].split(";")[0], raw))
        return f"![{m[1]}](image_{len(found)}.{found[-1][0]})"

    return re.sub(r"!\[([^\]]*)\]\((data:image/[^)]+)\)", put, text), found


def documents(spark):
    rng = random.Random(1)
    link = lambda: f"![{rng.choice(['', 'a b', 'x|$1'])}](data:image/{rng.choice(['png', 'svg+xml', 'jpeg;q=1'])};base64,{base64.b64encode(bytes(rng.randrange(3) for _ in range(rng.randrange(4)))).decode()})"
    bad = ["![x](data:image/png;base64)", "![x](data:image/png;base64,%%%)", "![x](image.png)", "![](data:text/plain;base64,QQ==)", "![x](data:image/png;base64,QQ=)"]
    texts = ["".join(rng.choice([link(), link(), rng.choice(bad), " text\n", "$1"]) for _ in range(rng.randrange(8))) for _ in range(150)]
    return texts, spark.createDataFrame([*enumerate(texts), (999, None)], "doc int, md string").repartition(3)


def test_extraction_equals_a_plain_loop(spark):
    texts, df = documents(spark)
    docs, images = I.extracted(df, "md")
    want = [plain(t) for t in texts]
    assert {r.doc: r.md for r in docs.collect()} == {k: w for k, (w, _) in enumerate(want)} | {999: None}
    got = sorted((r.doc, r.image, r.name, bytes(r.bytes), r.sha256, r.n_bytes) for r in images.collect())
    assert got == [(d, k, f"image_{k}.{kind}", raw, hashlib.sha256(raw).hexdigest(), len(raw)) for d, (_, found) in enumerate(want) for k, (kind, raw) in enumerate(found, 1)]


def test_each_content_is_stored_once(spark, tmp_path):
    texts, df = documents(spark)
    images, folder = I.extracted(df, "md")[1], str(tmp_path / "images")
    for half in (0, 1, 0):
        I.store(images.where(f"doc % 2 = {half}"), folder, 64)
    got = [(r.sha256, bytes(r.bytes)) for r in I.stored(spark, folder).collect()]
    want = {hashlib.sha256(raw).hexdigest(): raw for t in texts for _, raw in plain(t)[1]}
    assert len(got) == len(want) and dict(got) == want
    assert all(len(list(d.glob("*.parquet"))) == 1 for d in (tmp_path / "images").iterdir() if d.is_dir())


def test_links_of_many_bytes_have_no_line_break(spark, tmp_path):
    """45 characters of two bytes each are 120 characters of base64; a broken link of theirs stays as SQL writes it."""
    lines = ["é" * 60, "ab", "c", "ñ" * 45 + "x"]
    spark.createDataFrame([(k, "\n".join(lines)) for k in (7, 8)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text_sha256 for r in page_plans.str27_image_links(spark, str(tmp_path)).collect()}
    whole = lambda i, x: f"{x}![a {i}](data:image/{('png', 'jpeg')[i % 2]};base64,{base64.b64encode(x[:45].encode()).decode()}!) end"
    file = lambda i, x: f"{x}![a {i}](image_{i // 3 + 1}.{('png', 'jpeg')[i % 2]}) end"
    for doc, link in ((7, whole), (8, file)):
        text = "\n".join(link(i, x) if i % 3 == 0 else x for i, x in enumerate(lines))
        assert got[doc] == hashlib.sha256(text.encode()).hexdigest()
