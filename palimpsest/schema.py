"""Tables, vocabularies and fixed parameters of the document model."""

from __future__ import annotations

# The vocabularies of the model.
BLOCK_TYPES = ("Text", "Title", "Table", "Image", "Formula", "List", "Signature", "Stamp", "Separator", "Unknown")
ROLE_OF_TYPE = {"Text": "Paragraph", "Image": "Figure", "List": "ListItem"}
ROLES = ("Title", "Paragraph", "Table", "Figure", "Formula", "ListItem", "Signature", "Stamp", "Separator", "Unknown")
MODES = ("DocumentReconstruction", "VisualPreservation")
MODE_TOKENS = {"document": "DocumentReconstruction", "visual": "VisualPreservation"}
STATUSES = ("Queued", "Processing", "Completed", "Failed", "Cancelled")
FORMATS = {"Txt": "txt", "Latex": "tex", "Pdf": "pdf", "Json": "json"}
PROFILES = ("Fast", "Accurate", "Balanced")
STAGES = ("parseo", "raster", "ocr", "tablas", "texto", "composicion", "refinamiento")
REFINEMENT_STAGES = ("BeforeOcr", "AfterOcr", "BeforeBlueprint", "AfterBlueprint")

# Thresholds.
ACCEPT_CONFIDENCE = 0.74
RETRY_THRESHOLD, RETRY_GAIN, RETRY_SCORE, SAME_ORDER_BONUS = 0.78, 0.05, 0.55, 0.35
REPEAT_SIMILARITY = 0.86
#: layout confidence, overlap, binarization, smallest region, by profile.
PROFILE_THRESHOLDS = {"Fast": (0.25, 0.50, 0.35, 8), "Balanced": (0.30, 0.45, 0.30, 5), "Accurate": (0.40, 0.35, 0.25, 3)}
POINTS_PER_PIXEL = 0.48

TABLE_TYPE = (
    "struct<rows:array<array<struct<content:string,row_span:int,col_span:int,x:bigint,y:bigint,w:bigint,h:bigint,alignment:string,is_emphasized:boolean>>>,"
    "num_rows:int,num_cols:int,header_row_indices:array<int>,column_widths:array<int>>"
)
BLOCKS = (
    "doc_id bigint, page_no int, block_idx int, block_type string, x bigint, y bigint, w bigint, h bigint, content string, "
    f"confidence double, layout_confidence double, reading_order bigint, page_w bigint, page_h bigint, has_image boolean, table {TABLE_TYPE}"
)
JOBS = "job_id string, doc_id string, source_path string, status string, created_at timestamp, completed_at timestamp, profile string, error_message string, output_format string, mode_preference string"
EVENTS = "job_id string, seq bigint, ts timestamp, kind string, phase string, progress float, page int, total int, error string"
PAGE = ["doc_id", "page_no"]
