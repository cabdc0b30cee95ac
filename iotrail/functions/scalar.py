"""Column expressions shared by the trace families. Nothing here is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB = 1024
MIB = 1024 * 1024


def int_div(a: Column, b: Column | int) -> Column:
    """Integer division; for operands that are not negative."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def ceil_div(a: Column, b: Column | int) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    return int_div(a + b - 1, b)


def round_up(a: Column, unit: Column | int) -> Column:
    unit = unit if isinstance(unit, Column) else F.lit(unit)
    return ceil_div(a, unit) * unit


def bit(value: Column, n: int) -> Column:
    return F.getbit(value, F.lit(n))


def floor_log2(value: Column, cap: int | None = None) -> Column:
    """Exact floor(log2), from the binary digits; 0 for values below 1."""
    exact = F.when(value < 1, 0).otherwise(F.length(F.bin(value)) - 1).cast("long")
    return exact if cap is None else F.least(exact, F.lit(cap).cast("long"))


# ---- block layer ------------------------------------------------------------


def is_read(rwbs: Column) -> Column:
    return rwbs.contains("R")


def is_write(rwbs: Column) -> Column:
    return rwbs.contains("W")


def is_discard(rwbs: Column, action: Column) -> Column:
    return rwbs.contains("D") & (action != "D")


def rw_class(rwbs: Column) -> Column:
    """R if flagged read, else W if flagged write, else O."""
    return F.when(is_read(rwbs), "R").when(is_write(rwbs), "W").otherwise("O")


def op_class(rwbs: Column) -> Column:
    """Class by the first letter of the flags."""
    names = {"R": "read", "W": "write", "D": "discard", "F": "flush"}
    chain = F
    for letter, name in names.items():
        chain = chain.when(rwbs.startswith(letter), name)
    return chain.otherwise("other")


def nvme_class(command: Column) -> Column:
    text = F.lower(F.coalesce(command, F.lit("")))
    return (
        F.when(text.contains("read"), "read")
        .when(text.contains("write"), "write")
        .when(text.contains("flush"), "flush")
        .when(text.rlike("discard|dsm|deallocate"), "discard")
        .when(text.contains("identify"), "identify")
        .otherwise("other")
    )


def field_value(words: Column, name: str) -> Column:
    """The value of the first ``name=value`` among words, whatever the case of the name; null if there is none."""
    mark = f"{name}="
    found = F.get(F.filter(words, lambda w: F.lower(F.substr(w, F.lit(1), F.lit(len(mark)))) == mark), F.lit(0))
    return F.substr(found, F.lit(len(mark) + 1))


def nvme_extent(command: Column, block_bytes: int) -> dict[str, Column]:
    """slba, blocks, bytes and 512-byte sector of a command string (len is 0-based)."""
    given = F.split(F.translate(command, ",()", "   "), " +")
    slba = field_value(given, "slba").try_cast("long")
    length = F.coalesce(field_value(given, "len"), field_value(given, "nlb")).try_cast("long")
    nlb = F.coalesce(length + 1, F.lit(1).cast("long"))
    nlb = F.when(slba.isNotNull(), F.greatest(nlb, F.lit(1)))
    return {
        "slba": slba,
        "nlb": nlb,
        "bytes": nlb * block_bytes,
        "sector512": int_div(slba * block_bytes, 512),
    }


def namespace_name(device: Column) -> Column:
    """Generic character namespace (ngXnY) to block namespace (nvmeXnY)."""
    return F.regexp_replace(device, r"^ng(\d+n\d+)$", "nvme$1")


def device_candidates(device: Column) -> Column:
    """Names to try for a device: partition, namespace, controller."""
    namespace = F.regexp_replace(device, r"p\d+$", "")
    controller = F.regexp_replace(namespace, r"^(nvme\d+)n\d+$", "$1")
    return F.array_distinct(F.array(device, namespace, controller))


# ---- time and address bins ---------------------------------------------------


def time_bucket(ts: Column, start: int, width: int, buckets: int) -> Column:
    return F.least(int_div(ts - start, width), F.lit(buckets - 1).cast("long"))


def scaled_bin(value: Column, span: Column | int, bins: int) -> Column:
    """floor(value / span * bins), at most bins - 1."""
    span = span if isinstance(span, Column) else F.lit(span)
    return F.least(F.floor(value / span * bins), F.lit(bins - 1)).cast("long")


def closed_bin(value: Column, low: Column | float, high: Column | float, bins: int) -> Column:
    """Equal-width bin with the upper edge of the last bin closed."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    at = F.floor((value - low) / (high - low) * bins)
    return F.least(at, F.lit(bins - 1)).cast("long")


def right_closed_cut(value: Column, low: float, high: float, bins: int) -> Column:
    """Right-closed equal-width bin; the lowest value belongs to bin 0."""
    at = F.ceil((value - low) / ((high - low) / bins)) - 1
    return F.greatest(F.least(at, F.lit(bins - 1)), F.lit(0)).cast("long")


def zone(sector: Column, zone_sectors: int = 1_048_576, zones: int = 4096) -> Column:
    return F.least(int_div(sector, zone_sectors), F.lit(zones - 1).cast("long"))


# ---- sizes --------------------------------------------------------------------

# Labels of the fine size buckets with their upper bounds. Bounds
# up to 512 belong to the bucket, larger ones to the next.
SIZE_BUCKETS = (
    ("0 B", 0), ("1 B", 1), ("2-4 B", 4), ("5-8 B", 8), ("9-16 B", 16), ("17-32 B", 32),
    ("33-64 B", 64), ("65-128 B", 128), ("129-256 B", 256), ("257-512 B", 512),
    ("513-1023 B", KIB), ("1-2 KB", 2 * KIB), ("2-4 KB", 4 * KIB), ("4-8 KB", 8 * KIB),
    ("8-16 KB", 16 * KIB), ("16-32 KB", 32 * KIB), ("32-64 KB", 64 * KIB),
    ("64-128 KB", 128 * KIB), ("128-256 KB", 256 * KIB), ("256-512 KB", 512 * KIB),
    ("512KB-1MB", MIB), ("1-2 MB", 2 * MIB), ("2-4 MB", 4 * MIB), ("4-8 MB", 8 * MIB),
    ("8-16 MB", 16 * MIB), ("> 16 MB", None),
)

# Labels of the coarse left-closed size bins, in KiB from 512 B up.
COARSE_BINS = (
    "512B", "1K", "2K", "4K", "8K", "16K", "32K", "64K", "128K", "256K", "512K", "1M",
)


def size_bucket(size: Column) -> Column:
    chain = F
    for label, bound in SIZE_BUCKETS[:-1]:
        inside = size <= bound if bound <= 512 else size < bound
        chain = chain.when(inside, label)
    return chain.otherwise(SIZE_BUCKETS[-1][0])


def coarse_bin(size: Column) -> Column:
    """0-based left-closed bin from 512 B in doubling steps; null below 512 B."""
    return F.when(size >= 512, F.least(floor_log2(size) - 9, F.lit(len(COARSE_BINS) - 1)))


def power_ceiling(size: Column, largest: int) -> Column:
    """Smallest power of two from 2^9 to 2^24 that holds ``size``.

    Powers above twice the largest size are not offered; what fits in none goes
    to the last one.
    """
    top = 9
    while top < 24 and 2 ** (top + 1) <= 2 * largest:
        top += 1
    exact = floor_log2(size - 1) + F.when(size > 1, 1).otherwise(0)
    return F.least(F.greatest(exact, F.lit(9)), F.lit(top)).cast("long")


def sector_log_bucket(size: Column) -> Column:
    """floor(log2(bytes / 512)), at most 11."""
    return floor_log2(F.shiftright(size, 9), cap=11)


def size_group4(size: Column) -> Column:
    return (
        F.when(size < 4 * KIB, "<4K")
        .when(size < 64 * KIB, "4K-64K")
        .when(size < 256 * KIB, "64K-256K")
        .otherwise(">=256K")
    )


def size_group5(size: Column) -> Column:
    return (
        F.when(size <= 4 * KIB, "<=4K")
        .when(size <= 16 * KIB, "4K-16K")
        .when(size <= 128 * KIB, "16K-128K")
        .when(size <= MIB, "128K-1M")
        .otherwise(">1M")
    )


def bucket_group(index: Column) -> Column:
    """Groups over the log2 size bucket: small, medium, large, huge."""
    return (
        F.when(index < 13, "small")
        .when(index < 17, "medium")
        .when(index < 19, "large")
        .otherwise("huge")
    )


def human_size(size: Column) -> Column:
    """Bytes with a binary unit; one decimal unless the value is whole."""
    step = F.least(int_div(floor_log2(size), 10), F.lit(4)).cast("int")
    units = F.array(*[F.lit(u) for u in ("B", "KiB", "MiB", "GiB", "TiB")])
    unit = F.element_at(units, step + 1)
    scale = F.pow(F.lit(1024), step).cast("long")
    whole = size % scale == 0
    number = F.when(whole, int_div(size, scale).cast("string")).otherwise(
        F.format_string("%.1f", F.bround(size / scale, 1))
    )
    return F.concat(number, F.lit(" "), unit)


# ---- alignment ------------------------------------------------------------------


def unit_metrics(sector: Column, nblocks: Column, unit: int) -> dict[str, Column]:
    """How a request lies on indirection units of ``unit`` blocks."""
    first = int_div(sector, unit)
    last = int_div(sector + nblocks - 1, unit)
    touched = last - first + 1
    ideal = F.greatest(F.lit(1).cast("long"), ceil_div(nblocks, unit))
    return {
        "crossings": last - first,
        "touched": touched,
        "ideal": ideal,
        "aligned": (sector % unit == 0) & (nblocks % unit == 0),
        "waf": touched / ideal,
        "sub_unit": nblocks < unit,
    }


def quant_bin(nblocks: Column, unit: int) -> Column:
    """0 below one unit, the whole units up to 16, and 17 for more."""
    ratio = nblocks / unit
    return F.when(ratio < 1, 0).when(ratio <= 16, F.floor(ratio)).otherwise(17).cast("long")


def charged_bytes(sector: Column, size: Column, unit_bytes: Column | int) -> Column:
    """Whole-unit bytes a request of ``size`` bytes makes the device handle."""
    unit = unit_bytes if isinstance(unit_bytes, Column) else F.lit(unit_bytes)
    start = F.shiftleft(sector, 9)
    return (int_div(start + size - 1, unit) - int_div(start, unit) + 1) * unit


def geometry_unit(min_io: Column, physical: Column, is_nvme: Column) -> dict[str, Column]:
    """Indirection unit of a device from its queue limits, with the NVMe floor."""
    base = F.when(min_io > 0, min_io).when(physical > 0, physical).otherwise(512)
    floored = is_nvme & (physical == 512) & (base < 4096)
    return {"iu": F.when(floored, 4096).otherwise(base), "floored": floored}


def zero_based_bytes(raw: Column, block_bytes: int) -> Column:
    return (raw + 1) * block_bytes


def device_number(major: Column, minor: Column) -> Column:
    return F.shiftleft(major.cast("long"), 20).bitwiseOR(minor.cast("long"))


# ---- objects ----------------------------------------------------------------------


def tag_id(user_data: Column) -> Column:
    """Object id in the high half of an unsigned 64-bit tag held as DECIMAL(20,0)."""
    return F.floor(user_data / F.lit(4294967296)).cast("long")


def key_fields(key: Column) -> dict[str, Column]:
    """rank, short hash and format of a ``model@format@rank@hash`` key."""
    parts = F.split(key, "@")
    whole = F.size(parts) >= 4
    rank = F.when(F.get(parts, F.lit(2)).rlike(r"^\d+$"), F.get(parts, F.lit(2)).cast("long"))
    return {
        "rank": F.when(whole, rank),
        "chunk": F.when(whole, F.substring(F.get(parts, F.lit(3)), 1, 12)),
        "fmt": F.when(whole, F.get(parts, F.lit(1))),
    }


def command_role(tid: Column, op_name: Column, key_hex: Column | None = None) -> Column:
    untagged = tid == 0
    if key_hex is not None:
        untagged = untagged & (F.coalesce(key_hex, F.lit("")) == "")
    return (
        F.when(untagged, "untagged")
        .when(op_name.isin("write", "store"), "writes")
        .when(op_name.isin("read", "retrieve"), "reads")
        .otherwise("other")
    )


def path_id(*parts: Column) -> Column:
    """63-bit id of a '/'-joined path, from the first 8 bytes of its MD5."""
    digest = F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]).cast("binary"))
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def token_bytes(layers: Column, heads: Column, head_dim: Column, width: Column) -> Column:
    """Bytes one token takes: keys and values over all layers."""
    return 2 * layers * heads * head_dim * width


def split_sizes(size: Column, transfer: int, block_bytes: int) -> Column:
    """Sizes of the commands one transfer is split into; the tail fills blocks."""
    n = ceil_div(size, transfer)
    tail = round_up(size - (n - 1) * transfer, block_bytes)
    full = F.lit(round_to_block(transfer, block_bytes)).cast("long")
    sizes = F.concat(F.array_repeat(full, (n - 1).cast("int")), F.array(tail.cast("long")))
    return F.when(size > 0, sizes).otherwise(F.array().cast("array<bigint>"))


def round_to_block(size: int, block_bytes: int) -> int:
    return -(-size // block_bytes) * block_bytes


def project_object(
    payload: Column,
    op: Column,
    header_bytes: int = 4096,
    mdts_bytes: int = 131072,
    block_bytes: int = 512,
    max_transfer: int = 0,
) -> dict[str, Column]:
    """Device commands one object operation should need.

    Only the number of commands and the two sizes that occur are computed, so a
    huge object costs no more than a small one; see ``split_sizes`` for a list.
    """
    transfer = min(max_transfer, mdts_bytes) if max_transfer else mdts_bytes
    n = F.when(payload > 0, ceil_div(payload, transfer)).otherwise(0)
    full = round_to_block(transfer, block_bytes)
    tail = F.when(n > 0, round_up(payload - (n - 1) * transfer, block_bytes)).otherwise(0)
    n_header = -(-header_bytes // transfer)
    header_total = (n_header - 1) * full + round_to_block(
        header_bytes - (n_header - 1) * transfer, block_bytes
    )
    stored = op == "store"
    return {
        "device_ops": F.when(stored, 2).otherwise(1),
        "n_commands": n + F.when(stored, n_header).otherwise(0),
        "tail_bytes": tail,
        "total_bytes": F.greatest(n - 1, F.lit(0)) * full
        + tail
        + F.when(stored, header_total).otherwise(0),
    }


# ---- syscalls, faults, pages --------------------------------------------------------

# Syscall numbers whose direction is known.
IO_DIRECTION = {0: "READ", 17: "READ", 1: "WRITE", 18: "WRITE", 19: "VREAD", 20: "VWRITE"}

# open(2) flags.
OPEN_FLAGS = {
    "O_CREAT": 0o100, "O_EXCL": 0o200, "O_NOCTTY": 0o400, "O_TRUNC": 0o1000,
    "O_APPEND": 0o2000, "O_NONBLOCK": 0o4000, "O_DSYNC": 0o10000, "FASYNC": 0o20000, "O_DIRECT": 0o40000,
    "O_LARGEFILE": 0o100000, "O_DIRECTORY": 0o200000, "O_NOFOLLOW": 0o400000,
    "O_CLOEXEC": 0o2000000, "O_SYNC": 0o4010000, "O_PATH": 0o10000000,
}

# Command opcodes.
NVM_OPCODES = {0: "flush", 1: "write", 2: "read"}
KV_OPCODES = {1: "store", 2: "retrieve", 6: "list", 0x10: "delete", 0x14: "exist"}
RING_OPCODES = {
    1: "READV", 2: "WRITEV", 4: "READ_FIXED", 5: "WRITE_FIXED", 22: "READ", 23: "WRITE",
}


def named(code: Column, names: dict[int, str], default: str = "other") -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[code.cast("int")], F.lit(default))


def open_flags(flags: Column) -> Column:
    """Access mode and every set flag, as an array."""
    mode = F.element_at(
        F.array(*[F.lit(m) for m in ("O_RDONLY", "O_WRONLY", "O_RDWR", "O_ACCMODE")]),
        (flags.bitwiseAND(F.lit(3)) + 1).cast("int"),
    )
    each = [F.when(flags.bitwiseAND(F.lit(v)) == v, n) for n, v in OPEN_FLAGS.items()]
    return F.array_compact(F.array(mode, *each))


def fault_kept(flags: Column, ret: Column) -> Column:
    """False for faults that end in an error and are not counted."""
    return ret.bitwiseAND(F.lit(0x873)) == 0


def fault_major(ret: Column) -> Column:
    return ret.bitwiseAND(F.lit(0x404)) != 0


def vector_bytes(iov_sizes: Column, cap: int) -> dict[str, Column]:
    """Requested bytes of a vectored call whose decode stops after ``cap`` entries."""
    seen = F.slice(iov_sizes, 1, cap)
    total = F.aggregate(seen, F.lit(0).cast("long"), lambda a, x: a + x)
    whole = F.size(iov_sizes) <= cap
    return {
        "requested_bytes": F.when(whole, total),
        "requested_bytes_lower": total,
        "requested_bytes_valid": whole,
    }


def key_hex(words: list[Column], key_len: Column) -> Column:
    """Hex of a key held in little-endian 32-bit command words."""
    swapped = [
        F.concat(*[F.substring(F.lpad(F.hex(w.cast("long")), 8, "0"), 7 - 2 * i, 2) for i in range(4)])
        for w in words
    ]
    digits = F.lower(F.concat(*swapped))
    return F.substring(digits, F.lit(1), (F.least(key_len, F.lit(16)) * 2).cast("int"))


# Bit positions in a page-table entry.
PAGE_BITS = {"present": 63, "swapped": 62, "file_mapped": 61, "exclusive": 56, "soft_dirty": 55}

# Bit positions in the kernel page flags.
KERNEL_FLAGS = {
    "locked": 0, "referenced": 2, "dirty": 4, "lru": 5, "active": 6, "slab": 7,
    "writeback": 8, "mmap": 11, "swapbacked": 13,
}


def page_state(entry: Column) -> dict[str, Column]:
    state = {name: bit(entry, n) == 1 for name, n in PAGE_BITS.items()}
    pfn = entry.bitwiseAND(F.lit((1 << 55) - 1))
    return {**state, "pfn": F.when(state["present"] & (bit(entry, 62) == 0), pfn).otherwise(0)}


def page_letter(present: Column, swapped: Column, dirty: Column, file_mapped: Column) -> Column:
    shown = F.when(dirty, "D").when(file_mapped, "F").otherwise("P")
    return F.when(present, shown).when(swapped, "S").otherwise(".")


def block_granularity_kb(size: Column) -> Column:
    return (
        F.when(size <= 256 * KIB, 4)
        .when(size <= 4 * MIB, 16)
        .when(size <= 64 * MIB, 64)
        .when(size <= 512 * MIB, 256)
        .otherwise(1024)
    )


def heat_digit(raw: Column, per_level: int) -> Column:
    return F.least(int_div(raw, per_level), F.lit(9))


def frequency_digit(points: Column) -> Column:
    return F.when(points == 0, 0).otherwise(F.least(int_div(points * 8, 10000) + 1, F.lit(9)))


# ---- device health ---------------------------------------------------------------------


def celsius(temperature: Column) -> Column:
    return F.when(temperature > 200, temperature - 273).otherwise(temperature)


def units_gib(units: Column) -> Column:
    """Data units of 512,000 bytes in GiB."""
    return units * 512_000 / 2**30
