"""One season's pooled counts and its published summary, as fixed values."""

# Per period seen, marked, first_seen, recap_later, recap_now, at_risk
# summed over the strata Jack, Female, Male.
SEASON = [
    (1, 1, 1, 1, 0, 0, 0),
    (2, 4, 4, 4, 2, 0, 0),
    (3, 13, 10, 11, 1, 2, 2),
    (4, 149, 88, 148, 48, 1, 1),
    (5, 395, 139, 354, 50, 41, 48),
    (6, 545, 116, 494, 38, 51, 57),
    (7, 407, 46, 374, 18, 33, 44),
    (8, 223, 48, 197, 11, 26, 29),
    (9, 317, 107, 304, 21, 13, 14),
    (10, 289, 141, 273, 81, 16, 22),
    (11, 1110, 417, 1040, 223, 70, 87),
    (12, 1550, 549, 1345, 224, 205, 240),
    (13, 1402, 311, 1155, 49, 247, 259),
    (14, 16, 8, 15, 3, 1, 61),
    (15, 572, 62, 511, 11, 61, 63),
    (16, 49, 0, 36, 0, 13, 13),
]
COLUMNS = "t_k int, seen long, marked long, first_seen long, recap_later long, recap_now long, at_risk long"

# Published mean and sd of the season's fit.
PHI, P, NSUPER = (0.436560830381205, 0.0111889281816536), (0.800159597927293, 0.0133381054090276), (10523.804, 226.900438964769)
LAMBDA = {1: 0.382708943273482, 10: 0.382708761407479, 14: 0.379781637488183, 15: 0.349321898435423}
TAU = {1: 0.912761068054218, 14: 0.913375813573154, 15: 0.919790785286739, 16: 1.0}
# mean, sd, effective size of the mark rate
MARK = {
    2: (0.904303785176182, 0.127231727835179, 500), 3: (0.747390604386268, 0.112660463306274, 380),
    4: (0.587952753584472, 0.0394081025738359, 500), 5: (0.351560960606821, 0.0239822979706605, 140),
    6: (0.212921976516153, 0.0170493141504696, 160), 9: (0.339698741803826, 0.0255220924374879, 490),
    11: (0.376055897078155, 0.0153012410383971, 500), 13: (0.22202468738093, 0.01073262016576, 320),
    15: (0.108463845234397, 0.0126590638803817, 480),
}


def season(spark, **extra):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(SEASON, COLUMNS)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})
