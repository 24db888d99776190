"""Names, thresholds and vocabularies that results depend on."""

#: Official layers and their geometry.
LAYERS = {"IMB": "point", "SITE": "point", "BOITE": "point", "CABLE": "line", "PTECH": "point", "INFRASTRUCTURE": "line", "ZNRO": "polygon", "ZPM": "polygon"}
LAYER_ALIASES = {"INFRA": "INFRASTRUCTURE"}
DEVICE_WORDS = ("BOX", "BOITE", "PTECH", "IMB", "SITE", "ZNRO", "ZPM", "SRO")
REQUIRED_SUFFIXES = ("shp", "shx", "dbf", "prj")
EXPECTED_SHEETS = ("BOITE", "CABLE", "IMB", "INFRASTRUCTURE", "PTECH", "SITE", "ZNRO", "ZPM", "纤芯连接与分配", "BOM物料")
ROOT_CODES = ("POP", "SRO")

#: Words that stand for a missing value: in fields, in safety checks, in the adapter.
MISSING = ("NA", "N/A", "NULL", "NONE", "SANS OBJET", "/")
MISSING_SAFETY = ("", "NA", "N/A", "NULL", "NONE", "SANS OBJET", "-")
NULL_TOKENS = ("", "NULL", "None", "/", "N/A", " ")
REUSED = ("OUI", "YES", "1", "TRUE", "利旧", "REUSE", "REUTILISE", "REUTILISATION")

#: Severity by rule; a rule that is not listed is a warning.
SEVERITY = dict.fromkeys((
        "R001", "R002", "R003", "R004", "R007", "R010", "R013", "R014", "R015", "R016", "R017", "R023", "R033",
    ), "fatal") | dict.fromkeys(
    (
        "R005", "R005_1", "R005_2", "R005_3", "R005_4", "R006", "R006_3", "R006_4", "R006_5", "R006_6", "R007_1", "R007_2", "R008", "R011", "R012",
        "R019", "R020", "R021", "R022", "R-FIBER-001", "R-BOM-001",
    ), "error"
)
#: Category by rule; a rule that is not listed is engineering_reasonableness.
CATEGORY = (
    dict.fromkeys((
        "R001", "R002", "R003", "R004", "R005", "R006", "R007", "R016", "R017", "R018", "R021", "R032", "R033", "R-FLD-001", "R-FLD-002",
        "R-FILE-001",
    ), "data_completeness")
    | dict.fromkeys((
        "R010", "R014", "R025", "R026", "R027", "R028",
        "R-GIS-001", "R-GIS-002", "R-GIS-003", "R-GIS-004", "R-GIS-005", "R-GIS-006",
        "R-SAFE-001", "R-SAFE-002", "R-SAFE-003", "R-SAFE-004", "R-SAFE-005", "R-SAFE-006", "R-SAFE-007", "R-SAFE-008", "R-SAFE-009",
    ), "spatial_safety")
    | dict.fromkeys((
        "R011", "R012", "R019", "R020", "R022", "R-FIBER-001", "R-DAT-001", "R-BOM-001",
    ), "resource")
    | dict.fromkeys((
        "R008", "R009", "R005_4", "R-REL-001", "R-REL-004", "R023", "R024",
    ), "logic_consistency")
)
OTHER_CATEGORY = "engineering_reasonableness"

#: Rules by package category.
FULL_RULES = (
    "R001", "R002", "R003", "R004", "R005", "R005_4", "R007", "R008", "R009", "R010", "R011", "R013", "R014", "R015", "R016", "R017", "R018",
    "R032", "R019", "R020", "R021", "R022", "R023", "R-FIBER-001", "R-FIBER-002", "R-BOM-001", "R005_1", "R005_2", "R005_3", "R027", "R028",
    "R033",
)
ROUTES = dict.fromkeys(("full_design", "as_built", "as_built_bom", "design_fiber"), FULL_RULES) | {
    "survey_design": (
        "R001", "R002", "R003", "R004", "R005", "R007",
    ),
    "spreadsheet": (
        "R005", "R005_4", "R007", "R008", "R009", "R011", "R012", "R016", "R018", "R019", "R020", "R021", "R022", "R032", "R033", "R-FIBER-001",
        "R-BOM-001",
    ),
}

#: Least heights and clearances in metres.
GROUND_HEIGHT = {"wall": 4.5, "aerial": 5.5}
#: Kilovolts up to: (with, without lightning protection).
POWER_GAP = {10: (2.0, 4.0), 110: (3.0, 5.0), 220: (4.0, 6.0), 330: (5.0, 5.0), 500: (8.5, 8.5), 750: (12.0, 12.0), 1000: (18.0, 18.0)}
#: kind: (rule, parallel, crossing, words in the layer's name)
UTILITIES = {
    "power": ("R-SAFE-004", 0.2, 0.1, ("电力", "POWER", "ELEC")),
    "water": ("R-SAFE-005", 0.15, 0.1, ("给水", "WATER", "EAU")),
    "heat": ("R-SAFE-007", 0.5, 0.3, ("热力", "HEAT", "CHALEUR")),
    "lightning": ("R-SAFE-008", 1.0, 0.3, ("避雷", "LIGHTNING", "FOUDRE")),
    "ground": ("R-SAFE-009", 0.5, 0.2, ("保护地", "GROUND", "TERRE")),
    "gas": ("R-SAFE-013", 0.3, 0.1, ("燃气",)),
    "cable_line": ("R-SAFE-014", 0.15, 0.1, ("电缆线路",)),
}
#: facility: least parallel distances of its size variants, words in the layer's name.
BURIED = {"duct": ((0.75,), ("DUCT", "管道")), "water": ((0.5, 1.0, 1.5), ("WATER", "EAU", "给水")), "oil_gas": ((10.0,), ("OIL", "油")), "gas": ((1.0, 2.0), ("GAS", "燃气")), "heat": ((1.0,), ("HEAT", "CHALEUR", "热力")), "drain": ((0.8,), ("DRAIN", "排水")), "power": ((0.5, 2.0), ("POWER", "ELEC", "电力"))}
POLE_CLEARANCE = {"hydrant": (1.0, ("HYDRANT", "消防栓")), "tree": (0.5, ("TREE", "ARBRE", "树")), "building": (2.0, ("BUILDING", "BATIMENT", "IMB"))}
GROUNDING_INTERVAL = 500.0
BURIED_MODES, AERIAL_MODES = ("SOUTERRAIN", "ENTERRE", "BURIED", "直埋"), ("AERIEN", "AERIAL", "架空")

#: Bill of materials: (code, what it is, unit).
MATERIALS = {
    "cable": ("500002050", "fibre cable", "KM"), "steel_wire": ("200001033", "steel wire", "M"),
    "fdt": ("500002054", "FDT, 72 ports", "PC"), "box16": ("500002142", "box, 16 ports", "PC"),
}
LOSS = {"500002050": 0.05, "200001033": 0.03, "500002054": 0.01, "500002142": 0.01, "200000185": 0.03, "200000149": 0.02, "200000148": 0.02, "200000172": 0.02, "200000145": 0.02, "500001103": 0.02, "200000690": 0.03}
RESERVE = {"pcp": 1.35, "splice": 7.5, "manhole": 0.75, "pole": 7.5, "endpoint": 2.0}
PACK = {"500002050": 2.0, "200001033": 500.0}
EXACT = ("500000510",)
CORES_PER_PCP, BEND_PERMILLE = 4, 10

#: Fixed values of sheets: extra layer sheets, headers of rule sheets, words of file names.
BOM_SHEET, FIBER_SHEET = "BOM物料", "纤芯连接与分配"
RULE_SHEETS = ("校验规则", "规则")
RULE_FILES, PROCEDURE_FILES = ("规则", "字段说明"), ("规程", "知识库")
GIS_SUFFIXES, SHEET_SUFFIXES = ("qgs", "qgz", "shp", "gpkg"), ("xlsx", "xls")
CASE_DEVICES = ("BOITE", "SITE", "PTECH", "IMB", "INFRASTRUCTURE", "ZNRO", "ZPM")

#: Official field of a header. In CABLE sheets 类型 is TYPE_CABLE.
HEADER_ALIASES = {
    "编码": "CODE", "编号": "CODE", "代码": "CODE", "起点": "ORIGINE", "上游": "ORIGINE", "终点": "EXTREMITE", "下游": "EXTREMITE",
    "容量": "CAPACITE", "类型": "TYPE", "型号": "TYPE", "数量": "QTY", "已用纤芯": "NB_FIBRE_UTIL", "纤芯数": "NB_FIBRE_UTIL",
    "长度": "LONGUEUR", "高度": "HAUTEUR_APPUI", "MATERIAL CODE": "CODE", "物料编码": "CODE", "物料名称": "NAME",
    "归属PM": "REF_PM", "所属PM": "REF_PM", "所属NRO": "REF_NRO", "状态": "STATUT", "生产商": "FABRIQUANT", "产品编号": "REF_PRODUIT",
}

#: Full name of a field whose name a shapefile cuts to ten characters.
TRUNCATED = {
    "CODE_POSTA": "CODE_POSTAL", "NB_LOGEMEN": "NB_LOGEMENT", "NB_FIBRE_U": "NB_FIBRE_UTIL", "NB_FIBRE_D": "NB_FIBRE_DISP", "NB_CASSETT": "NB_CASSETTES_MAX",
    "CABLE_AMON": "CABLE_AMONT", "PROPRIETAI": "PROPRIETAIRE", "GESTIONNAI": "GESTIONNAIRE", "REF_PRODUI": "REF_PRODUIT", "NB_FIBRE_": "NB_FIBRE_UTIL",
    "NUMERO_VOI": "NUMERO_VOIE", "COMPLEME_1": "COMPLEMENT_VOIE", "NOM_BATIME": "NOM_BATIMENT", "TYPE_BATIM": "TYPE_BATIMENT", "TYPE_CLIEN": "TYPE_CLIENT",
    "RACCORDEME": "RACCORDEMENT", "NUM_GESTIO": "NUM_GESTIONNAIRE", "COL_MONTAN": "COL_MONTANTE", "SOUS_SOL_C": "SOUS_SOL_COMMUN", "HAUTEUR_AP": "HAUTEUR_APPUI",
    "EFFORT_APP": "EFFORT_APPUI", "NB_BOITIER": "NB_BOITIERS", "CODE_PT": "CODE_PTC",
}

#: Greatest lengths that override those of the field specifications.
LENGTH_OVERRIDES = {"CABLE_AMONT": 30}

#: Material codes where a project has no official list.
MATERIAL_CODES = (
    "500003800", "500003890", "500002050", "500002054", "500002142", "500000510", "200000290", "200000273", "200000288", "500001742", "500002155", "500002480",
    "500002337", "500002159", "500004729", "200000185", "200001033", "200000149", "200000148", "200000172", "200000145", "500001103", "200000690", "500002107",
    "500001519", "500002108", "500002108-1", "500001887", "500001853",
)

#: Source fields, in order of preference, of the unified engineering objects.
_REUSE_FIELDS = ("REUSE", "REUTILISATION", "REUSE_FLAG", "REUTILISE")
ENGINEERING_OBJECTS = {
    "cable": {
        "code": ("CODE", "CABLE_CODE"), "longueur": ("LONGUEUR", "LGR_REELLE", "LGR_CARTO"), "capacite": ("CAPACITE", "CAPACITY", "FIBER_COUNT"),
        "type": ("TYPE_CABLE", "TYPE"), "nb_fibre_util": ("NB_FIBRE_U", "NB_FIBRE_UTIL", "NB_FIBRE_D", "fiber_count"), "hauteur_appui": (), "reuse": _REUSE_FIELDS,
    },
    "boite": {
        "code": ("CODE", "BOITE_CODE", "ID"), "longueur": (), "capacite": ("CAPACITE", "CAPACITY"), "type": ("TYPE", "TYPE_BOITE", "BOXTYPE", "TYPE_FONC", "FONCTION"),
        "nb_fibre_util": ("NB_FIBRE_U", "NB_FIBRE_UTIL", "NBFUTILE"), "hauteur_appui": ("HAUTEUR_AP", "HAUTEUR_APPUI", "HAUTEUR"), "reuse": _REUSE_FIELDS,
    },
    "ptech": {
        "code": ("CODE", "PTECH_CODE"), "longueur": (), "capacite": ("CAPACITE", "CAPACITY"), "type": ("TYPE",),
        "nb_fibre_util": ("NB_FIBRE_U", "NB_FIBRE_UTIL"), "hauteur_appui": ("HAUTEUR_AP", "HAUTEUR_APPUI"), "reuse": _REUSE_FIELDS,
    },
    "site": {
        "code": ("CODE", "SITE_CODE"), "longueur": (), "capacite": ("CAPACITE", "CAPACITY", "NB_PRISES"), "type": ("TYPE",),
        "nb_fibre_util": ("NB_FIBRE_U", "NB_FIBRE_UTIL"), "hauteur_appui": (), "reuse": _REUSE_FIELDS,
    },
    "infrastructure": {
        "code": ("CODE", "INFRA_CODE"), "longueur": ("LONGUEUR", "LGR_REELLE", "LGR_CARTO"), "capacite": ("CAPACITE", "CAPACITY"), "type": ("TYPE", "TYPE_LOG"),
        "nb_fibre_util": ("NB_FIBRE_U", "NB_FIBRE_UTIL"), "hauteur_appui": (), "reuse": _REUSE_FIELDS,
    },
}
NUMERIC_FIELDS = ("longueur", "capacite", "nb_fibre_util", "hauteur_appui")
