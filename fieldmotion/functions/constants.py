"""Field geometry, image size and class codes that results depend on."""

# Yards.
FIELD_LENGTH = 120.0
FIELD_WIDTH = 53.33
GOAL_LEFT, GOAL_RIGHT = 10.0, 110.0
HASH_NEAR_Y, HASH_FAR_Y = 23.583, 53.33 - 23.583
NUMBER_NEAR_Y, NUMBER_FAR_Y = 13.0, 40.33
NUMBER_NEAR_INSIDE_Y, NUMBER_FAR_INSIDE_Y = 14.0, 39.33
YARD_LINES = 21

# Pixels.
IMAGE_W, IMAGE_H = 1280, 720

# Token types.
YARD, SIDE, HASH, NUMBER = 0, 1, 2, 3

# Painted number labels in field order, and their index among the 21 line classes.
PAINTED_LABELS = ["10L", "20L", "30L", "40L", "50", "40R", "30R", "20R", "10R"]
PAINTED_TO_LINE = [2, 4, 6, 8, 10, 12, 14, 16, 18]

# Correspondence kinds and the y each one stands for.
KIND_Y = {
    "near_hash": HASH_NEAR_Y,
    "far_hash": HASH_FAR_Y,
    "sideline_near": 0.0,
    "sideline_far": FIELD_WIDTH,
    "number_near": NUMBER_NEAR_INSIDE_Y,
    "number_far": NUMBER_FAR_INSIDE_Y,
}
