"""Native Spark expressions: inspection, planning, formatting and path safety.  Nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .codecs import CODECS

# --- fixed values: signatures at the start of files, in order of precedence ---------------------
#: (hex prefix, type, detail)
MAGIC = [
    ("535041434B", "Archive", "spack"), ("FFD8FF", "Image", "jpeg"), ("89504E470D0A1A0A", "Image", "png"), ("47494638", "Image", "gif"), ("424D", "Image", "bmp"),
    ("49492A00", "Image", "tiff"), ("4D4D002A", "Image", "tiff"), ("RIFF", None, None), ("ftyp", "Video", "mp4"), ("1A45DFA3", "Video", "matroska"),
    ("494433", "Audio", "mp3"), ("FFFB", "Audio", "mp3"), ("FFF3", "Audio", "mp3"), ("FFF2", "Audio", "mp3"), ("4F676753", "Audio", "ogg"), ("664C6143", "Audio", "flac"),
    ("7F454C46", "Executable", "elf"), ("4D5A", "Executable", "pe"), ("CAFEBABE", "Executable", "mach-o"), ("CFFAEDFE", "Executable", "mach-o"),
    ("CEFAEDFE", "Executable", "mach-o"), ("FEEDFACE", "Executable", "mach-o"), ("0061736D", "Executable", "wasm"),
    ("504B0304", "Archive", "zip"), ("504B0506", "Archive", "zip"), ("1F8B", "Archive", "gzip"), ("425A68", "Archive", "bzip2"), ("FD377A585A00", "Archive", "xz"),
    ("28B52FFD", "Archive", "zstd"), ("377ABCAF271C", "Archive", "7z"), ("25504446", "Binary", "pdf"), ("EFBBBF", "Text", "utf8-bom"), ("2321", "Text", "script"), ("1F9D", "Archive", "compress"),
]
#: type: "extension[=detail]" words; the detail is the extension where none is given
EXTENSIONS = {
    "Text": "txt=text md=markdown markdown csv tsv json jsonl yaml yml=yaml toml ini cfg=config log xml html htm=html css js=javascript mjs=javascript ts=typescript "
    "tsx=typescript jsx=javascript py=python go rs=rust c h=c-header hpp=cpp-header cc=cpp cpp cxx=cpp kt=kotlin java rb=ruby sh=shell bash=shell zsh=shell fish=shell nix sql "
    "tex=latex svg gv=graphviz mermaid",
    "Image": "bmp tiff tif=tiff ppm pgm pbm jpeg png gif webp heic avif",
    "Audio": "wav aiff au mid=midi mp3 aac ogg opus flac",
    "Video": "mp4 m4v mkv=matroska webm mov",
    "Executable": "o=object so=elf dll=pe",
    "Archive": "tar iso deb=ar rpm a=ar zip gz=gzip bz2=bzip2 xz zst=zstd 7z rar docx=zip xlsx=zip pptx=zip jar=zip apk=zip spk=spack",
    "Binary": "bin=raw dat=data db=database sqlite",
}
#: Details whose payload is compressed already.
DENSE = "jpeg png gif webp heic avif mp3 aac ogg opus flac mp4 m4v matroska webm mov zip gzip bzip2 xz zstd 7z rar spack".split()
#: The words that a strict check knows: extensions, not details, so gzip, bzip2, zstd and matroska are missed.
DENSE_STRICT = "jpeg png gif webp heic avif mp3 aac ogg opus flac mp4 m4v mkv webm mov zip gz bz2 xz zst 7z rar docx xlsx pptx jar apk spk".split()
TYPE_NAMES = ["Unknown", "Text", "Image", "Audio", "Video", "Executable", "Archive", "Binary"]


def extensions(spark: SparkSession) -> DataFrame:
    """The dimension (ext, type, detail): fixed and small, to be broadcast."""
    rows = [(e, kind, d or e) for kind, words in EXTENSIONS.items() for e, _, d in (w.partition("=") for w in words.split())]
    return spark.createDataFrame(rows, "ext string, ext_type string, ext_detail string")


def extension(path: Column) -> Column:
    """Lower-cased letters behind the last dot of a path; '' if there is no dot."""
    return F.when(F.instr(path, ".") > 0, F.lower(F.substring_index(path, ".", -1))).otherwise("")


def detect_header(head: Column) -> Column:
    """struct(type, detail) by the first bytes (binary), or null."""
    digits = F.hex(F.substring(head, 1, 16))

    def kind(t: str, d: str) -> Column:
        return F.struct(F.lit(t).alias("type"), F.lit(d).alias("detail"))

    out = None
    for prefix, t, d in MAGIC:
        if prefix == "RIFF":
            here = digits.startswith("52494646") & (F.octet_length(head) >= 12)
            tag = F.substring(digits, 17, 8)
            value = F.when(tag == "57454250", kind("Image", "webp")).when(tag == "57415645", kind("Audio", "wav")).when(tag == "41564920", kind("Video", "avi")).otherwise(kind("Binary", "riff"))
        elif prefix == "ftyp":
            here, value = digits.startswith("000000") & (F.substring(digits, 9, 8) == "66747970"), kind(t, d)
        else:
            here, value = digits.startswith(prefix), kind(t, d)
        out = F.when(here, value) if out is None else out.when(here, value)
    return out


def printable(head: Column) -> Column:
    """struct(type, detail) by the first 4096 bytes: a NUL makes it binary, 95 % of text bytes make it text."""
    part = F.substring(head, 1, 4096)
    n = F.octet_length(part)
    # ISO 8859-1 has a character for each byte, so byte classes are character classes
    chars = F.decode(part, "ISO-8859-1")
    bad = F.length(F.regexp_replace(chars, r"[\t\n\r\x20-\x7E\x80-\xFF]", ""))
    text = (F.instr(chars, "\x00") == 0) & (n > 0) & ((n - bad) * 100 >= n * 95)
    return F.when(text, F.struct(F.lit("Text").alias("type"), F.lit("text").alias("detail"))).otherwise(F.struct(F.lit("Binary").alias("type"), F.lit("binary").alias("detail")))


def detect_types(files: DataFrame, path: str = "path", head: str = "head") -> DataFrame:
    """Adds type and type_detail: by signature, else by extension, else by the look of the first bytes (none: binary).  Input columns of these names are replaced, all others pass unchanged."""
    dim = F.broadcast(extensions(files.sparkSession))
    kept = [c for c in files.columns if c.lower() not in ("type", "type_detail")]
    # the input rides in a struct, so its names can't meet those of the dimension
    out = files.select(F.struct(*[F.col(f"`{c}`") for c in files.columns]).alias("input"))
    out = out.join(dim, extension(F.col(f"input.`{path}`")) == F.col("ext"), "left")
    by_ext = F.when(F.col("ext").isNotNull(), F.struct(F.col("ext_type").alias("type"), F.col("ext_detail").alias("detail")))
    first = F.col(f"input.`{head}`")
    found = F.coalesce(detect_header(first), by_ext, printable(first))
    return out.select("input", found.alias("found")).select(*[F.col(f"input.`{c}`").alias(c) for c in kept], F.col("found.type").alias("type"), F.col("found.detail").alias("type_detail"))


def type_from_name(name: Column) -> Column:
    """The type that a name in any case means, or null."""
    return reduce(lambda c, t: c.when(F.lower(name) == t.lower(), t), TYPE_NAMES, F.when(F.lit(False), F.lit("")))


def type_id(name: Column) -> Column:
    """The number of a type in containers; 0 (unknown) for other names."""
    return reduce(lambda c, t: c.when(F.lower(name) == t[1].lower(), t[0]), enumerate(TYPE_NAMES), F.when(F.lit(False), F.lit(0))).otherwise(0).cast("int")


def is_dense(kind: Column, detail: Column, strict: bool = False) -> Column:
    """Whether a format is compressed already, so that trials are vain."""
    return F.coalesce((kind == "Video") | detail.isin(DENSE_STRICT if strict else DENSE), F.lit(False))


# --- planning -----------------------------------------------------------------------------------


def block_cap(algo: Column) -> Column:
    return reduce(lambda c, x: c.when(algo == x.name, F.lit(x.block_cap)), CODECS.values(), F.when(F.lit(False), F.lit(0))).cast("bigint")


def chunk_size(level: Column, cap: Column, memory: Column, threads: Column) -> Column:
    """64 KiB doubled with each level up to 4 MiB, within the codec's cap and a third of a thread's memory (0: unlimited), 4096 at least."""
    level = F.greatest(F.lit(1), F.least(F.lit(9), level)).cast("int")
    size = F.least(F.lit(65536).cast("bigint") * F.pow(F.lit(2), level - 1).cast("bigint"), F.lit(4 << 20).cast("bigint"), cap.cast("bigint"))
    share = F.floor(memory / (F.greatest(threads, F.lit(1)) * 3)).cast("bigint")
    return F.greatest(F.lit(4096).cast("bigint"), F.when(memory > 0, F.least(size, share)).otherwise(size))


def level_of(priority: Column) -> Column:
    return F.when(priority == "max-speed", 1).when(priority == "balanced", 6).when(priority == "max-ratio", 9)


#: Names that users give, by meaning (fixed values).
PRIORITIES = {"max-speed": "speed max-speed max_speed maxspeed", "max-ratio": "ratio max-ratio max_ratio maxratio", "balanced": "balance balanced default"}
MODES = {"compress": "compress c pack", "decompress": "decompress d unpack extract", "benchmark": "benchmark bench b"}


def alias_of(word: Column, names: dict[str, str]) -> Column:
    """The meaning of a word in any case, or null."""
    return reduce(lambda c, kv: c.when(F.lower(word).isin(kv[1].split()), kv[0]), names.items(), F.when(F.lit(False), F.lit("")))


# --- formatting and paths -----------------------------------------------------------------------


def fixed(x: Column, places: int) -> Column:
    """A double with so many decimals, as C's printf writes it: the binary value is rounded, and a tie goes to the even digit.

    x * 10**places is taken as a rounded product and its exact error (Dekker's split), so that ties are told from values next to them.
    Beyond 2**45 the decimals are the JVM's. Null for null.
    """
    scale = 10**places
    size = F.abs(x)
    high = size * F.lit(134217729.0) - (size * F.lit(134217729.0) - size)
    product = size * F.lit(float(scale))
    error = (high * F.lit(float(scale)) - product) + (size - high) * F.lit(float(scale))
    whole = F.floor(product)
    over = (product - whole - F.lit(0.5)) + error
    up = (over > 0) | ((over == 0) & (whole % 2 == 1))
    digits = whole.cast("bigint") + up.cast("bigint")
    text = F.format_string(f"%s%d.%0{places}d", F.when(F.signum(x) < 0, F.lit("-")).otherwise(F.lit("")), F.floor(digits / scale).cast("bigint"), F.pmod(digits, F.lit(scale)))
    return F.when(size < F.lit(float(1 << 45)), text).when(x.isNotNull(), F.format_string(f"%.{places}f", x))


#: Units of sizes, each 1024 of the one before; below the first are bytes.
SIZE_UNITS = ["KiB", "MiB", "GiB", "TiB", "PiB"]


def human_size(n: Column, largest: str = SIZE_UNITS[-1]) -> Column:
    """1024-based, two decimals from KiB on; sizes beyond the largest unit stay in it. Null for null."""
    out = F.when(n < 1024, F.format_string("%d B", n.cast("bigint")))
    last = SIZE_UNITS.index(largest) + 1
    for k, unit in enumerate(SIZE_UNITS[: last - 1], 1):
        out = out.when(n < 1024 ** (k + 1), F.concat(fixed(n.cast("double") / 1024**k, 2), F.lit(f" {unit}")))
    return out.otherwise(F.concat(fixed(n.cast("double") / 1024**last, 2), F.lit(f" {largest}")))


def human_rate(mbps: Column) -> Column:
    return F.when(mbps >= 1000, F.concat(fixed(mbps / 1000, 2), F.lit(" GB/s"))).otherwise(F.concat(fixed(mbps, 2), F.lit(" MB/s")))


def format_ratio(ratio: Column) -> Column:
    return fixed(ratio, 4)


_SIZE = r"^(\d+)(?:([kKmMgG])(?:[iI]?[bB])?)?$"


def parse_size(text: Column) -> Column:
    """Bytes of '64K', '4MiB', '1gb' or '123'; null for anything else."""
    unit = F.lower(F.regexp_extract(text, _SIZE, 2))
    times = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)
    return F.when(text.rlike(_SIZE), F.regexp_extract(text, _SIZE, 1).cast("bigint") * times.cast("bigint"))


def safe_path(path: Column) -> Column:
    """Whether a relative path stays below its root: not empty or absolute, no '..' part, no drive letter, no backslash, no NUL."""
    return (path != "") & ~path.rlike(r"^/|\\|^.:|(^|/)\.\.(/|$)") & (F.instr(path, "\x00") == 0)


def safe_name(name: Column) -> Column:
    """Whether a name is one harmless path component."""
    return (name != "") & ~name.isin(".", "..") & ~name.rlike(r"[/\\\x00-\x1f\x7f]")


def sanitize(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1f\x7f]", "?")


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(text: Column) -> Column:
    """Bytes of hex digits with white space anywhere; an odd last digit is left out, other characters give null."""
    digits = F.regexp_replace(text, r"\s", "")
    return F.when(digits.rlike(r"^[0-9A-Fa-f]*$"), F.unhex(F.substring(digits, F.lit(1), (F.floor(F.length(digits) / 2) * 2).cast("int"))))


def archive_kind(head: Column) -> Column:
    """Standard archive format by signature: zip, 7z, rar, zst, gz, xz, bz2, lz4, Z, lzma, ar, cpio or tar; else null."""
    digits = F.hex(F.substring(head, 1, 8))
    out = F.when(digits.startswith("504B0304") | digits.startswith("504B0506") | digits.startswith("504B0708"), "zip")
    for prefix, kind in [("377ABCAF271C", "7z"), ("526172211A07", "rar"), ("28B52FFD", "zst"), ("1F8B", "gz"), ("FD377A585A00", "xz"), ("425A68", "bz2"), ("04224D18", "lz4"), ("1F9D", "Z"), ("5D0000", "lzma"), ("213C617263683E0A", "ar"), ("303730373031", "cpio"), ("303730373032", "cpio"), ("303730373037", "cpio")]:
        out = out.when(digits.startswith(prefix), kind)
    return out.when(looks_like_tar(head), "tar")


def looks_like_tar(head: Column) -> Column:
    return F.hex(F.substring(head, 258, 5)) == "7573746172"


def archive_kind_of_name(path: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for suffix, kind in [(".tar.gz", "tar.gz"), (".tgz", "tar.gz"), (".tar.xz", "tar.xz"), (".txz", "tar.xz"), (".tar.bz2", "tar.bz2"), (".tbz2", "tar.bz2"), (".zip", "zip"), (".7z", "7z"), (".tar", "tar")]:
        out = out.when(path.endswith(suffix), kind)
    return out


def drop_route(kind: Column, archive: Column, detail: Column | None = None) -> Column:
    """What to do with a file that is dropped on the engine: archives and own containers are extracted, media shrunk, the rest compressed."""
    own = F.lit(False) if detail is None else F.coalesce(detail == "spack", F.lit(False))
    return F.when(archive.isNotNull() | own, "extract").when(kind.isin("Image", "Video"), "shrink").otherwise("compress")


#: Part sizes that are offered for volumes (fixed values).
PART_SIZES = {"1 mb": 1 << 20, "10 mb": 10 << 20, "100 mb": 100 << 20, "cd": 700 << 20, "fat32": (4 << 30) - 1}


def part_size(name: Column) -> Column:
    """Bytes of a named part size, or of a written one."""
    return F.coalesce(reduce(lambda c, kv: c.when(F.lower(name) == kv[0], F.lit(kv[1]).cast("bigint")), PART_SIZES.items(), F.when(F.lit(False), F.lit(0).cast("bigint"))), parse_size(name))


def fuzzy_rank(name: Column, pattern: Column) -> Column:
    """How well a name fits what was typed: null unless it has the typed letters in their order, in any case; else the letters between the first and the last of the first such run, so 0 is best."""
    letters = F.filter(F.split(F.lower(pattern), ""), lambda c: c != "")
    run = F.array_join(F.transform(letters, lambda c: F.when(c.rlike(r"^[\p{L}\p{N}]$"), c).otherwise(F.concat(F.lit("\\"), c))), ".*?")
    found = F.call_function("regexp_extract", F.lower(name), F.concat(F.lit("("), run, F.lit(")")), F.lit(1))
    return F.when(pattern == "", 0).when(found != "", F.length(found) - F.length(pattern))


def list_dir(entries: DataFrame, name: str = "name", is_dir: str = "is_dir", hidden: bool = False) -> DataFrame:
    """Entries in display order: directories first, then names regardless of case; dot files only if wanted."""
    out = entries if hidden else entries.where(~F.col(name).startswith("."))
    return out.orderBy(F.col(is_dir).desc(), F.lower(name), name)
