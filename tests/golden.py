"""Published inputs and results of one stock, small enough to write down."""

# (region, year, biomass, cv) of the surveys used in 2022; 2020 used those before 2022
SURVEY = [
    ("AI", 1991, 6153.3, 0.23939602), ("AI", 1994, 6243.8, 0.16047401), ("AI", 1997, 8894.4, 0.1815494),
    ("AI", 2000, 10648.5, 0.18617706), ("AI", 2002, 14244.2, 0.20396522), ("AI", 2004, 17334.7, 0.19096616),
    ("AI", 2006, 17877.8, 0.12151323), ("AI", 2010, 18074.6, 0.15952868), ("AI", 2012, 14443.4, 0.15159017),
    ("AI", 2014, 17610.9, 0.24448396), ("AI", 2016, 16541.0, 0.1619413), ("AI", 2018, 13215.7, 0.19949502),
    ("AI", 2022, 12867.1, 0.15538253), ("EBS Slope", 2002, 16940.3469, 0.11567358),
    ("EBS Slope", 2004, 18792.7759, 0.08952124), ("EBS Slope", 2008, 26054.6433, 0.1245379),
    ("EBS Slope", 2010, 29334.4963, 0.11657837), ("EBS Slope", 2012, 29564.6369, 0.10658357),
    ("EBS Slope", 2016, 35947.6046, 0.11479163), ("SBS", 1991, 187.4, 0.57781284),
    ("SBS", 1994, 1070.8, 0.51981881), ("SBS", 1997, 1545.1, 0.68503167), ("SBS", 2000, 1051.3, 0.47613523),
    ("SBS", 2002, 1012.0, 0.4050634), ("SBS", 2004, 945.4, 0.55565262), ("SBS", 2006, 967.9, 0.54832951),
    ("SBS", 2010, 1052.3, 0.73258206), ("SBS", 2012, 451.8, 0.76770689), ("SBS", 2014, 2567.2, 0.66924288),
    ("SBS", 2016, 1607.4, 0.53478262), ("SBS", 2018, 1604.8, 0.68208484), ("SBS", 2022, 1277.6, 0.74537008),
]
# (year, cpue, cv) of the line survey on the slope
INDEX = [
    (1997, 12109.8445, 0.228254), (1999, 4191.7106, 0.12378119), (2001, 9444.2911, 0.23623054),
    (2003, 11049.9174, 0.27020136), (2005, 13503.3695, 0.15116577), (2007, 13135.4531, 0.28480034),
    (2009, 16118.2149, 0.222975), (2011, 28629.8274, 0.16889164), (2013, 24759.91, 0.08751167),
    (2015, 31781.5291, 0.13698349), (2017, 28294.8366, 0.14042451), (2019, 26073.2587, 0.15901179),
    (2021, 25496.8909, 0.18299648),
]
NLL_2020, LOG_SIGMA_2020, LOG_DET_2020, BIOMASS_2020 = 11.2577596745371, -2.11057730229020, 2.88361, 50693.5
# estimate, std_err, lci, uci
MODEL_20 = (0.117279, 0.026840, 0.074888, 0.183665)
MODEL_22 = (0.166954, 0.032738, 0.113681, 0.245192)
MODEL_22_Q = (0.703460, 0.063100, 0.590047, 0.838671)
# year -> total biomass by model
TOTALS = {
    1991: (24899.752610581807, 18612.77451531449),
    2010: (46488.63145054258, 47806.41352888753),
    2023: (49271.16610545453, 51098.265841378336),
}
NON_SST_2023 = 1635.2224952782954
