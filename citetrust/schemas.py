"""Column layouts of the tables that pass between operators, and of the stored artifacts."""

# In memory.
REVISIONS_TEXT = "page_id bigint, rev_id bigint, pos bigint, text string"
PAIRS = (
    "page_id bigint, rev_id_ta bigint, rev_id_tr bigint, "
    "src_ta array<string>, src_tr array<string>"
)
REVISIONS = (
    "revision_id bigint, pair_id bigint, page_id bigint, "
    "ta boolean, tr boolean, ta_gt boolean, tr_gt boolean, src array<string>"
)
SOURCE_PROBS = "src string, p_added double, p_removed double, occurrences bigint"

# Stored: column names and types are a fixed format shared with existing artifacts.
STORED_PAIRS = (
    "revIdTA bigint, revIdTR bigint, pageId int, srcTA array<string>, srcTR array<string>"
)
STORED_REVISIONS = (
    "revId bigint, pairId bigint, pageId int, "
    "tA string, tR string, tA_GT string, tR_GT string, src array<string>"
)
