"""Published results the roll-up must reproduce (fixed values)."""

# benchmark: (board raw, board skill, board coverage, score, answered, requests)
ENTRANT_02 = {
    1: (0.9126, 0.8821, 1, 0.9126, 1694, 1694), 2: (0.4202, 0.3616, 1, 0.4202, 1000, 1000),
    3: (0.0, 0.0, 0.0, None, 0, 508), 4: (0.0, 0.0, 0.0, None, 0, 3080), 5: (0.0, 0.0, 0.0, None, 0, 5500),
    6: (0.7946, 0.5165, 1, 0.7946, 10000, 10000), 9: (0.225, 0.225, 1.0, 0.225, 160, 160),
    10: (0.6461, 0.4111, 1.0, 0.6461, 2500, 2500), 11: (0.6963, 0.5609, 1, 0.6963, 123, 123),
    12: (0.6105, 0.4166, 1.0, 0.6105, 3200, 3200), 20: (0.8384, 0.6768, 1, 0.8356, 5000, 5000),
    21: (0.5955, 0.191, 1, 0.5955, 2628, 2628), 22: (0.0, 0.0, 0, None, 0, 2000),
    23: (0.5686, 0.1371, 1, 0.591, 5000, 5000), 25: (0.3878, 0.1837, 1, 0.3878, 196, 196),
    28: (0.6788, 0.3576, 1.0, 0.6788, 1267, 1267), 29: (0.8435, 0.7913, 1.0, 0.8435, 10042, 10042),
    30: (0.3173, 0.1763, 1, 0.3173, 2638, 2638), 31: (0.0692, 0.0, 0.3176, 0.2179, 1588, 5000),
    32: (0.5412, 0.2706, 1.0, 0.5412, 752, 752), 33: (0.303, 0.2937, 1.0, 0.303, 1650, 1650),
    36: (0.1602, 0.1193, 1, 0.1602, 550, 550), 37: (0.3809, 0.2234, 1, 0.3809, 5000, 5000),
    38: (0.015, 0.015, 1.0, 0.015, 1565, 1565), 39: (0.8112, 0.7223, 1.0, 0.8112, 979, 979),
    40: (0.4103, 0.2414, 1, 0.4103, 4600, 4600), 41: (0.4397, 0.1595, 1, 0.4397, 3006, 3006),
    42: (0.7803, 0.5726, 1.0, 0.7803, 5500, 5500), 43: (0.4754, 0.1677, 1, 0.4754, 570, 570),
    44: (0.6332, 0.2664, 1, 0.6332, 5000, 5000), 45: (0.0978, 0.0, 1.0, 0.0978, 501, 501),
    48: (0.0904, 0.0904, 1.0, 0.2274, 10139, 10139), 50: (0.4153, 0.1514, 1, 0.4153, 1676, 1676),
    56: (0.6175, 0.235, 1.0, 0.6175, 2000, 2000), 57: (0.4796, 0.4147, 1.0, 0.4796, 12032, 12032),
    58: (0.6301, 0.4638, 1.0, 0.6301, 5507, 5507), 59: (0.7248, 0.5325, 1.0, 0.7248, 2700, 2700),
    61: (0.6432, 0.2864, 1.0, 0.6432, 4000, 4000), 62: (0.6216, 0.4955, 1.0, 0.6216, 3652, 3652),
    64: (0.5701, 0.4626, 1.0, 0.5701, 528, 528),
}
SCORES_02 = {"balanced_raw": 45.59, "balanced_skill": 30.01, "breadth_skill": 28.72}

# benchmark: (chance, rows, correct of two entrants, skill x100 of the same)
VISION = {
    "CV-Bench": (0.393825646058227, 2038, (1749, 1728), (76.61, 74.91)),
    "BLINK": (0.3540582726326743, 961, (731, 707), (62.95, 59.08)),
    "RealWorldQA": (0.3880871533672892, 589, (488, 500), (71.98, 75.31)),
    "CharXiv": (0.25, 532, (451, 432), (79.7, 74.94)),
    "InfographicVQA": (0.25, 244, (241, 236), (98.36, 95.63)),
    "Mind2Web": (0.25, 973, (817, 825), (78.62, 79.72)),
    "Winoground": (0.5, 800, (735, 735), (83.75, 83.75)),
    "KIE (CORD+FUNSD)": (0.39259634888438133, 2465, (2345, 2342), (91.99, 91.78)),
    "Moderation (Hateful Memes)": (0.5, 1213, (851, 827), (40.31, 36.36)),
    "R-Bench-M": (0.16679197994987469, 665, (281, 212), (30.7, 18.24)),
    "MMMU-Pro vision": (0.12811840535828978, 1730, (826, 183), (40.07, -2.56)),
}
VISION_INDEX = (72.78, 69.8)
