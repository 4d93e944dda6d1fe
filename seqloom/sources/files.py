"""Sequence files: FASTA, a subset of GenBank, position matrices, and delimited tables.

Sequence files of SnapGene are read too: a packet of bases and one of features in XML.

Files are read by Spark, so any store and any number of files will do: FASTA by splitting at lines that begin with `>`, also
within files;
GenBank and motif files whole, one row each, and parsed in Arrow batches.
"""

from __future__ import annotations

import re
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import FEATURES

RECORD = f"name string, q string, circular boolean, features {FEATURES}"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, description and q of each entry."""
    # a file's first entry still has its mark
    rows = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", r"^\s*>", "").alias("value")).where(F.regexp_replace("value", r"\s", "") != "")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    return rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), F.upper(body).alias("q"))


def fasta_text(rows: DataFrame, name: str = "name", q: str = "q", width: int = 60) -> DataFrame:
    """A row of text for each sequence."""
    lines = F.array_join(F.regexp_extract_all(F.col(q), F.lit(f".{{1,{width}}}"), F.lit(0)), "\n")
    return rows.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), lines).alias("value"))


def write_fasta(rows: DataFrame, path: str, name: str = "name", q: str = "q") -> None:
    fasta_text(rows, name, q).write.mode("overwrite").text(path)


def parse_place(text: str) -> tuple[int, int, int] | None:
    """The span of a GenBank location, half-open from 0."""
    numbers = [int(x) for x in re.findall(r"\d+", text)]
    return (min(numbers) - 1, max(numbers), -1 if "complement" in text else 1) if numbers else None


def parse_genbank(text: str) -> list[tuple]:
    """name, sequence, circular and features of each record of a file."""
    out = []
    for record in re.split(r"^//\s*$", text, flags=re.M):
        if not (locus := re.search(r"^LOCUS\s+(\S+)(.*)$", record, re.M)):
            continue
        origin = re.search(r"^ORIGIN.*?$(.*)\Z", record, re.M | re.S)
        q = re.sub(r"[^A-Za-z]", "", origin[1]).upper() if origin else ""
        features: list[dict] = []
        table = re.search(r"^FEATURES.*?$(.*?)(?=^\S|\Z)", record, re.M | re.S)
        key = None
        for line in (table[1] if table else "").splitlines():
            if m := re.match(r" {5}(\S+)\s+(\S.*)$", line):
                features.append({"type": m[1], "at": m[2].strip(), "qualifiers": {}})
                key = None
            elif features and (m := re.match(r"\s+/(\w+)(?:=(.*))?$", line)):
                key = m[1]
                features[-1]["qualifiers"].setdefault(key, []).append((m[2] or "").strip())
            elif features and line.strip():
                if key is None:
                    features[-1]["at"] += line.strip()
                else:
                    features[-1]["qualifiers"][key][-1] += " " + line.strip()
        made = []
        for f in features:
            if place := parse_place(f["at"]):
                quals = {k: [x.strip('"').replace('""', '"') for x in v] for k, v in f["qualifiers"].items()}
                made.append({"type": f["type"], "start": place[0], "end": place[1], "strand": place[2], "qualifiers": quals})
        out.append((locus[1], q, "circular" in locus[2].lower(), made))
    return out


def genbank_text(name: str, q: str, circular: bool, features: list[dict], max_name: int = 20) -> str:
    """A record as GenBank text; features without a place are left out and long names are cut."""
    lines = [f"LOCUS       {name[:max_name]:<20} {len(q)} bp    DNA     {'circular' if circular else 'linear'} UNK 01-JAN-1980", "FEATURES             Location/Qualifiers"]
    for f in features:
        if f["start"] is None or f["end"] is None:
            continue
        at = f"{f['start'] + 1}..{f['end']}"
        lines.append(f"     {f['type']:<15} {f'complement({at})' if f['strand'] == -1 else at}")
        for key, values in (f["qualifiers"] or {}).items():
            lines += [f"                     /{key}=\"{v.replace(chr(34), chr(34) * 2)}\"" for v in values]
    lines.append("ORIGIN")
    for i in range(0, len(q), 60):
        lines.append(f"{i + 1:>9} " + " ".join(q[j : j + 10].lower() for j in range(i, min(i + 60, len(q)), 10)))
    return "\n".join([*lines, "//"])


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """The records of GenBank files."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for text in pdf["value"] for r in parse_genbank(text)], columns=["name", "q", "circular", "features"])

    return _whole(spark, path).mapInPandas(run, RECORD)


def write_genbank(records: DataFrame, path: str) -> None:
    """Records (name, q, circular, features) as text, one record after another."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = pdf.to_dict("records")
            yield pd.DataFrame({"value": [genbank_text(r["name"], r["q"], bool(r["circular"]), [dict(f) | {"qualifiers": dict(f["qualifiers"] or {})} for f in r["features"]]) for r in rows]})

    records.mapInPandas(run, "value string").write.mode("overwrite").text(path)


def parse_snapgene(data: bytes, name: str) -> tuple:
    """name, sequence, circular and features of a file: packets of a type, a length and so many bytes."""
    at, q, circular, features = 0, "", False, []
    while at + 5 <= len(data):
        kind, n = data[at], int.from_bytes(data[at + 1 : at + 5], "big")
        body = data[at + 5 : at + 5 + n]
        if at == 0 and (kind != 9 or body[:8] != b"SnapGene"):
            raise ValueError(f"{name} is no SnapGene file")
        if kind == 0 and n:
            circular, q = bool(body[0] & 1), body[1:].decode("ascii").upper()
        elif kind == 10:
            for f in ElementTree.fromstring(body.decode("utf-8")).iter("Feature"):
                ranges = [tuple(map(int, s.get("range").split("-"))) for s in f.iter("Segment")]
                quals = {"label": [f.get("name", "")]}
                for x in f.iter("Q"):
                    quals[x.get("name")] = [v.get("text") or v.get("int") or v.get("predef") or "" for v in x.iter("V")]
                if ranges:
                    strand = {"1": 1, "2": -1}.get(f.get("directionality", "0"), 0)
                    features.append({"type": f.get("type", "misc_feature"), "start": min(a for a, _ in ranges) - 1, "end": max(b for _, b in ranges), "strand": strand, "qualifiers": quals})
        at += 5 + n
    return name, q, circular, features


def read_snapgene(spark: SparkSession, path: str) -> DataFrame:
    """The records of SnapGene files, named by their files."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([parse_snapgene(bytes(b), p.rsplit("/", 1)[-1].removesuffix(".dna")) for p, b in zip(pdf["path"], pdf["content"], strict=True)], columns=["name", "q", "circular", "features"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, RECORD)


def load_records(spark: SparkSession, path: str, file_format: str = "auto") -> DataFrame:
    """Records of a file or folder, by its ending or a given format: fasta, genbank or snapgene."""
    kind = file_format
    if kind == "auto":
        ending = path.rstrip("/").rpartition(".")[2].lower()
        kind = {"gb": "genbank", "gbk": "genbank", "genbank": "genbank", "fa": "fasta", "fasta": "fasta", "dna": "snapgene"}.get(ending)
    if kind == "genbank":
        return read_genbank(spark, path)
    if kind == "snapgene":
        return read_snapgene(spark, path)
    if kind == "fasta":
        return read_fasta(spark, path).select("name", "q", F.lit(False).alias("circular"), F.array().cast(FEATURES).alias("features"))
    raise ValueError(f"no such format: {path}")


def parse_motifs(text: str) -> list[tuple[str, int, str, float]]:
    """name, position, base and count of JASPAR, MEME or TRANSFAC matrices."""
    out: list[tuple[str, int, str, float]] = []
    numbers = lambda x: [float(n) for n in re.findall(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", x)]
    if text.lstrip().startswith(">"):
        for block in re.split(r"^>", text, flags=re.M)[1:]:
            head, *rows = block.strip().splitlines()
            for k, row in enumerate(r for r in rows if r.strip()):
                base = m[1] if (m := re.match(r"\s*([ACGT])\b", row)) else "ACGT"[k]
                out += [(head.split()[0], i, base, n) for i, n in enumerate(numbers(re.sub(r"^\s*[ACGT]\b", "", row)))]
    elif "letter-probability matrix" in text:
        for m in re.finditer(r"^MOTIF\s+(\S+).*?letter-probability matrix:(.*?)\n(.*?)(?=^MOTIF|\Z)", text, re.M | re.S):
            sites = float(n[1]) if (n := re.search(r"nsites=\s*([\d.]+)", m[2])) else 1.0
            rows = [numbers(r) for r in m[3].splitlines()]
            out += [(m[1], i, b, p * sites) for i, row in enumerate(r for r in rows if len(r) == 4) for b, p in zip("ACGT", row, strict=True)]
    else:
        name, at = "", 0
        for line in text.splitlines():
            if m := re.match(r"(?:ID|AC)\s+(\S+)", line):
                name, at = m[1], 0
            elif re.match(r"\d+\s", line) and len(n := numbers(line)) >= 5:
                out += [(name, at, b, x) for b, x in zip("ACGT", n[1:5], strict=True)]
                at += 1
    return out


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """motif, pos, base, count."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for text in pdf["value"] for r in parse_motifs(text)], columns=["motif", "pos", "base", "count"])

    return _whole(spark, path).mapInPandas(run, "motif string, pos int, base string, count double")


def read_pairs(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """key and value of a delimited file without a header."""
    return spark.read.csv(path, sep=sep, schema="key string, value string")
