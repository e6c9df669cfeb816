"""Which operations a document's permissions allow without its owner's password."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The permission that forbids an operation; those under "always" need the owner.
FORBIDDEN_BY = {
    "always": ("Decrypt", "Encrypt", "CombinePages"),
    "NoAssemble": (
        "AddBookmarks", "PadBefore", "PadAfter", "PadEvery", "PadMultiple", "PadMultipleBefore", "Merge", "Split", "SplitOnBookmarks", "SplitMax", "Spray", "RotateContents", "Rotate",
        "Rotateby", "Upright", "VFlip", "HFlip", "Impose", "Chop", "ChopHV", "Redact", "RedactShape", "RedactApply", "RedactApplyType", "Portfolio",
    ),
    "NoEdit": (
        "TwoUp", "TwoUpStack", "RemoveBookmarks", "AddRectangle", "RemoveText", "Draft", "Shift", "ShiftBoxes", "Scale", "ScaleToFit", "Stretch", "CenterToFit", "RemoveAttachedFiles",
        "RemoveAnnotations", "RemoveFonts", "Crop", "RemoveCrop", "Trim", "RemoveTrim", "Bleed", "RemoveBleed", "Art", "RemoveArt", "CopyBox", "MediaBox", "HardBox", "SetTrapped", "SetUntrapped",
        "Presentation", "BlackText", "BlackLines", "BlackFills", "CopyFont", "StampOn", "StampUnder", "StampAsXObject", "AddText", "ScaleContents", "AttachFile", "ThinLines", "RemoveClipping",
        "RemoveAllText", "Prepend", "Postpend", "Draw", "ProcessImages",
    ),
}
# Bits of the encryption dictionary's permission word, from 1; a bit that is not set forbids.
BITS = {"NoPrint": 3, "NoEdit": 4, "NoCopy": 5, "NoAnnot": 6, "NoForms": 9, "NoExtract": 10, "NoAssemble": 11, "NoHqPrint": 12}


def bans(spark: SparkSession) -> DataFrame:
    """(operation, ban): one row an operation that a ban forbids."""
    return spark.createDataFrame([(op, ban) for ban, ops in FORBIDDEN_BY.items() for op in ops], "operation string, ban string")


def banned(documents: DataFrame, word: str = "permissions") -> DataFrame:
    """documents with banned: the names of the permissions that a document's word leaves out; none for one without encryption (a null word)."""
    names = F.array(*[F.when(F.col(word).bitwiseAND(1 << (bit - 1)) == 0, F.lit(name)) for name, bit in BITS.items()])
    return documents.withColumn("banned", F.when(F.col(word).isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(names)))


def allowed(documents: DataFrame, requests: DataFrame, by: str, owner: str = "owner") -> DataFrame:
    """``requests`` (by, operation) with allowed: whether each may run on its document (by, banned, owner).

    The owner may do all; without encryption (no bans) everything is allowed but
    what always needs the owner of an encrypted document.  The table of bans has
    fewer than a hundred rows.
    """
    rules = F.broadcast(bans(requests.sparkSession))
    joined = requests.join(documents.select(by, "banned", owner, F.col("permissions").isNotNull().alias("encrypted")), by).join(rules, "operation", "left")
    forbidden = F.when(F.col("ban") == "always", F.col("encrypted")).otherwise(F.coalesce(F.array_contains("banned", F.col("ban")), F.lit(False)))
    return joined.withColumn("allowed", F.col(owner) | ~forbidden).select(*requests.columns, "allowed")


def merge_allowed(inputs: DataFrame, output: str = "output") -> DataFrame:
    """(output, allowed): a merge may run if every input's owner agrees or its permissions let it be assembled."""
    one = F.col("owner") | ~F.array_contains("banned", "NoAssemble")
    return inputs.groupBy(output).agg(F.min(one).alias("allowed"))
