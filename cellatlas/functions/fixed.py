"""Word lists and tables that decide results, so they must be exactly these."""

# Fixed values

GENE_PATTERN = r"^[A-Z][A-Z0-9]{1,14}(?:-[A-Z0-9]{1,6})?$"

GENE_PREFIXES = (
    "CD", "HLA", "KRT", "COL", "MUC", "SCGB", "FOXJ", "FOXI", "DNAH", "KLRC", "KLRD", "KLRK", "GZMB", "PRF1", "IFNG",
    "TPSAB", "TPSB", "CPA", "MS4A", "ATP6", "IGHJ", "IGLJ", "IGKJ", "TRAJ", "TRBV", "TRDJ", "IGH", "IGL", "IGK",
    "SLC", "ABCC", "CXCL", "CXCR", "CCL", "CCR", "IL",
)

ORDINARY_WORDS = (
    "cell", "cells", "type", "the", "and", "in", "of", "with", "activation", "expression", "signaling", "response",
    "pathway", "infiltration", "dysfunction", "remodeling", "increased", "reduced", "cystic", "fibrosis", "lung",
    "airways", "bronchial", "epithelium", "immune", "inflammatory", "antigen", "presentation", "cytotoxicity",
    "degranulation", "checkpoint", "inhibiting", "activity", "abundance", "changes", "across", "receptor", "hypoxia",
    "allergic", "defense", "helper", "killer", "natural", "pulmonary", "endothelial", "epithelial", "fibroblast",
    "macrophage", "monocyte", "dendritic", "basal", "ciliated", "secretory", "goblet", "club", "ionocyte", "mast",
    "plasma", "mature", "cytotoxic", "innate", "lymphoid", "stemness", "ciliogenesis", "immunoglobulin",
)

QUERY_SYNONYMS = {
    "endothelial": ("endocardial cell", "endothelial cell", "vascular endothelial"),
    "endothelial cell": ("endocardial cell", "endothelial cell"),
    "submucosal gland": ("mucus secreting cell of bronchus submucosal gland", "serous cell of epithelium of bronchus"),
    "submucosal": ("mucus secreting cell of bronchus submucosal gland",),
    "goblet": ("bronchial goblet cell", "nasal mucosa goblet cell", "respiratory tract goblet cell"),
    "ciliated": ("respiratory tract multiciliated cell", "ciliated cell"),
    "multiciliated": ("respiratory tract multiciliated cell",),
    "fibroblast": ("fibroblast of lung", "alveolar adventitial fibroblast", "alveolar type 1 fibroblast cell"),
    "nk cell": ("natural killer cell",),
    "nk": ("natural killer cell",),
    "t cell": ("mature T cell", "CD8-positive, alpha-beta T cell", "CD4-positive helper T cell", "cytotoxic T cell"),
    "cd8": ("CD8-positive, alpha-beta T cell",),
    "cd4": ("CD4-positive helper T cell",),
    "dc": ("dendritic cell, human",),
    "dendritic": ("dendritic cell, human",),
    "pnec": ("pulmonary neuroendocrine cell",),
    "neuroendocrine": ("pulmonary neuroendocrine cell",),
}

CLUSTER_ALIASES = {
    "respiratory tract multiciliated cell": ("ciliated cell", "multiciliated cell"),
    "CD8-positive, alpha-beta T cell": ("CD8 T cell", "CD8+ T cell", "cytotoxic T lymphocyte"),
    "CD4-positive helper T cell": ("CD4 T cell", "CD4+ T cell", "helper T cell"),
    "dendritic cell, human": ("dendritic cell", "DC"),
    "natural killer cell": ("NK cell", "NK"),
    "innate lymphoid cell": ("ILC",),
    "non-classical monocyte": ("CD16+ monocyte", "patrolling monocyte"),
    "mucus secreting cell of bronchus submucosal gland": ("submucosal gland cell", "mucous cell", "gland mucous cell"),
    "alveolar adventitial fibroblast": ("adventitial fibroblast",),
    "alveolar type 1 fibroblast cell": ("AT1 fibroblast",),
    "fibroblast of lung": ("lung fibroblast", "pulmonary fibroblast"),
    "respiratory tract suprabasal cell": ("suprabasal cell",),
    "respiratory tract goblet cell": ("goblet cell",),
    "bronchial goblet cell": ("airway goblet cell",),
    "nasal mucosa goblet cell": ("nasal goblet cell",),
    "epithelial cell of lung": ("lung epithelial cell", "pulmonary epithelial"),
    "pulmonary neuroendocrine cell": ("PNEC", "neuroendocrine cell"),
    "endocardial cell": ("endothelial cell", "vascular endothelial"),
    "mature T cell": ("T lymphocyte", "T cell"),
    "cytotoxic T cell": ("CTL", "killer T cell"),
}

CONDITION_WORDS = (
    "patient_group", "case_control", "condition", "disease", "treatment", "status", "health_status", "tissue_status",
    "genotype", "phenotype", "diagnosis", "sample_type", "group",
)

NO_CONDITION_WORDS = (
    "batch", "lab", "donor", "sample", "plate", "lane", "seq", "lib", "run", "class", "subclass", "level",
    "annotation", "ontology", "type", "assay", "sex", "ethnicity", "development", "suspension", "publication", "primary",
)

ANNOTATION_KEYS = (
    "cell_type", "celltype", "cell_annotation", "annotation", "CellType", "cell_label", "ann_level_3", "ann_level_2",
    "ann_finest_level", "cell_type_ontology_term_id",
)

CLUSTERING_KEYS = ("leiden", "louvain", "seurat_clusters", "cluster", "clusters", "Cluster", "group")

SYMBOL_COLUMNS = (
    "feature_name", "gene_short_name", "gene_name", "gene_symbols", "symbol", "gene_symbol", "features", "name", "gene",
)

S_PHASE = (
    "MCM5", "PCNA", "TYMS", "FEN1", "MCM2", "MCM4", "RRM1", "UNG", "GINS2", "MCM6", "CDCA7", "DTL", "PRIM1", "UHRF1",
    "MLF1IP", "HELLS", "RFC2", "RPA2", "NASP", "RAD51AP1", "GMNN", "WDR76", "SLBP", "CCNE2", "UBR7", "POLD3", "MSH2",
    "ATAD2", "RAD51", "RRM2", "CDC45", "CDC6", "EXO1", "TIPIN", "DSCC1", "BLM", "CASP8AP2", "USP1", "CLSPN", "POLA1",
    "CHAF1B", "BRIP1", "E2F8",
)

G2M_PHASE = (
    "HMGB2", "CDK1", "NUSAP1", "UBE2C", "BIRC5", "TPX2", "TOP2A", "NDC80", "CKS2", "NUF2", "CKS1B", "MKI67", "TMPO",
    "CENPF", "TACC3", "FAM64A", "SMC4", "CCNB2", "CKAP2L", "CKAP2", "AURKB", "BUB1", "KIF11", "ANP32E", "TUBB4B",
    "GTSE1", "KIF20B", "HJURP", "CDCA3", "HN1", "CDC20", "TTK", "CDC25C", "KIF2C", "RANGAP1", "NCAPD2", "DLGAP5",
    "CDCA2", "CDCA8", "ECT2", "KIF23", "HMMR", "AURKA", "PSRC1", "ANLN", "LBR", "CKAP5", "CENPE", "CTCF", "NEK2",
    "G2E3", "GAS2L3", "CBX5", "CENPA",
)

DISPLAY_NAMES = {
    "CD8-positive, alpha-beta T cell": "CD8+ T",
    "CD4-positive helper T cell": "CD4+ T helper",
    "CD4-positive, alpha-beta T cell": "CD4+ T",
    "respiratory tract multiciliated cell": "multiciliated",
    "respiratory tract suprabasal cell": "suprabasal",
    "respiratory tract goblet cell": "resp. goblet",
    "mucus secreting cell of bronchus submucosal gland": "submucosal gland",
    "nasal mucosa goblet cell": "nasal goblet",
    "alveolar adventitial fibroblast": "adventitial fib.",
    "alveolar type 1 fibroblast cell": "AT1 fibroblast",
    "bronchial goblet cell": "bronchial goblet",
    "pulmonary neuroendocrine cell": "neuroendocrine",
    "non-classical monocyte": "non-class. mono.",
    "epithelial cell of lung": "lung epithelial",
    "fibroblast of lung": "lung fibroblast",
    "dendritic cell, human": "dendritic",
    "innate lymphoid cell": "ILC",
    "natural killer cell": "NK",
    "endocardial cell": "endocardial",
    "secretory cell": "secretory",
    "stromal cell": "stromal",
    "mature T cell": "mature T",
    "cytotoxic T cell": "cytotoxic T",
    "plasma cell": "plasma",
    "mast cell": "mast",
    "club cell": "club",
    "basal cell": "basal",
    "macrophage": "macrophage",
    "monocyte": "monocyte",
    "pericyte": "pericyte",
    "ionocyte": "ionocyte",
    "B cell": "B cell",
}
