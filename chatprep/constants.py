"""Values every operator agrees on."""

# --- Fixed values -----------------------------------------------------------
# Special token ids and their texts; real characters start at id 4.
PAD_ID = 0
BOS_ID = 1
EOS_ID = 2
UNK_ID = 3
PAD_TEXT = "<pad>"
BOS_TEXT = "<bos>"
EOS_TEXT = "<eos>"
UNK_TEXT = chr(0x0F0B)
N_SPECIAL = 4

# Field names tried, in this order, for the two sides of a paired record.
INPUT_CANDIDATES = [
    "instruction", "input", "prompt", "question", "user", "query",
    "text", "context", "src", "source", "human", "request",
]
OUTPUT_CANDIDATES = [
    "output", "response", "answer", "assistant", "completion",
    "target", "tgt", "reply", "result", "gpt", "response_text", "value",
]

# Speaker names of the two sides in `from`/`value` records.
HUMAN_ALIASES = ["human", "user"]
MODEL_ALIASES = ["gpt", "assistant", "model", "chatbot"]

# Code points that count as white space when text is stripped.
WHITESPACE = "".join(
    chr(point)
    for point in [
        0x0009, 0x000A, 0x000B, 0x000C, 0x000D, 0x001C, 0x001D, 0x001E, 0x001F, 0x0020,
        0x0085, 0x00A0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006,
        0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    ]
)

# Sample length and the largest batch each model size allows.
BLOCK_SIZES = {"small": 128, "medium": 256, "large": 512, "xlarge": 768, "max": 1024}
BATCH_CAPS = {"xlarge": 8, "max": 4}
MIN_BLOCK = 16
MAX_BLOCK = 2048

SPLIT_SEED = 42
MIN_LR_RATIO = 0.1
# -----------------------------------------------------------------------------

# One row of a vocabulary per Unicode code point at most: the bound that makes a
# vocabulary safe to broadcast or to hold on the driver.
MAX_CODE_POINTS = 0x110000
