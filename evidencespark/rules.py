"""Rule dictionaries and thresholds. All are defaults: operators take others as parameters.

Fixed values: the word lists and patterns below equal those of the rules that results must match, in their order; the first
that matches wins.
"""

from __future__ import annotations

SECTORS: dict[str, tuple[str, ...]] = {
    "salud": ("hospital", "centro de salud", "establecimiento de salud", "posta medica", "posta de salud", "clinica", "policlinico", "instituto nacional de salud", "red de salud", "micro red", "centro materno", "materno infantil", "inen", "essalud"),
    "educacion": ("colegio", "institucion educativa", "escuela", "universidad", "centro educativo", "liceo", "i.e.", "ie ", "cetpro", "instituto pedagogico", "unidad escolar"),
    "vial": ("carretera", "via ", "puente", "autopista", "pista", "camino vecinal", "trocha", "avenida", "pavimentacion", "vial", "intercambio vial", "ovalo", "bypass"),
    "saneamiento": ("agua potable", "alcantarillado", "desague", "planta de tratamiento", "saneamiento", "ptar", "ptap", "reservorio", "captacion", "sistema de agua", "red de agua", "red de desague"),
    "edificacion": ("edificio", "vivienda", "residencial", "condominio", "edificacion", "complejo habitacional"),
    "riego": ("irrigacion", "riego", "canal", "bocatoma", "represa", "presa", "sistema de riego", "drenaje agricola"),
    "transporte": ("terminal terrestre", "aeropuerto", "puerto", "muelle", "embarcadero", "estacion", "ferrocarril", "metro", "tren"),
    "deportivo": ("estadio", "coliseo", "polideportivo", "complejo deportivo", "losa deportiva", "campo deportivo"),
    "institucional": ("palacio municipal", "municipalidad", "sede institucional", "local institucional", "comisaria", "local comunal"),
}

ACTIONS: dict[str, tuple[str, ...]] = {
    "construccion": ("construccion", "construir"), "mejoramiento": ("mejoramiento", "mejorar"), "ampliacion": ("ampliacion", "ampliar"),
    "rehabilitacion": ("rehabilitacion", "rehabilitar"), "remodelacion": ("remodelacion", "remodelar"), "supervision": ("supervision", "supervisar"),
    "expediente tecnico": ("expediente tecnico", "elaboracion del expediente", "estudio definitivo"), "instalacion": ("instalacion", "instalar"),
    "creacion": ("creacion", "crear"), "sustitucion": ("sustitucion", "sustituir", "reposicion"), "demolicion": ("demolicion", "demoler"), "mantenimiento": ("mantenimiento", "conservacion"),
}

ROLE_SYNONYMS: tuple[tuple[str, ...], ...] = (
    ("especialista bim", "gestor bim", "coordinador bim", "lider bim", "supervisor bim", "bim manager", "ingeniero bim", "arquitecto bim", "especialista bim manager", "especialista bim management"),
    ("especialista en costos", "especialista en costos y presupuestos", "especialista en metrados", "especialista en metrados costos y valorizaciones", "especialista en costos metrados y valorizaciones", "especialista en metrados costos y presupuestos"),
    ("especialista en equipamiento", "especialista en equipamiento y mobiliario", "especialista en equipamiento biomedico", "especialista en equipamiento medico hospitalario", "ingeniero especialista en equipamiento medico hospitalario"),
    ("especialista en seguridad", "especialista en seguridad y medio ambiente", "especialista de seguridad y medio ambiente", "especialista en seguridad salud y medio ambiente", "especialista en seguridad y salud ocupacional", "especialista ssoma"),
    ("jefe de supervision", "jefe supervisor", "supervisor de obra", "jefe de elaboracion del expediente tecnico", "jefe"),
    ("especialista en instalaciones electricas", "especialista electromecanico", "ingeniero especialista en instalaciones electricas", "ingeniero especialista en instalaciones electricas y mecanicas", "ingeniero especialista en instalaciones electricas y electromecanicas", "ingeniero electrico"),
    ("especialista en comunicaciones", "especialista en tecnologias de la informacion", "especialista en tecnologias de la informacion y comunicacion", "especialista en cableado estructurado", "especialista en redes de cableado estructurado y comunicaciones", "especialista en configuraciones tecnologicas"),
)

#: Roles that begin a row of a requirement table, accents left out.
ROLE_CATALOGUE: tuple[str, ...] = (
    "GERENTE DE CONTRATO", "GERENTE DE PROYECTO", "GERENTE DE OBRA", "JEFE DE SUPERVISION", "JEFE DE PROYECTO", "JEFE DE OBRA", "DIRECTOR DE PROYECTO", "COORDINADOR DE OBRA", "COORDINADOR DE PROYECTO",
    "INGENIERO DE CAMPO", "INGENIERO RESIDENTE", "RESIDENTE DE OBRA", "RESIDENTE DE SUPERVISION", "ASISTENTE DE SUPERVISION", "ASISTENTE TECNICO",
    "ESPECIALISTA EN ARQUITECTURA", "ESPECIALISTA EN ARQUITECTURA HOSPITALARIA", "ESPECIALISTA EN ESTRUCTURAS", "ESPECIALISTA EN INSTALACIONES SANITARIAS", "ESPECIALISTA EN INSTALACIONES ELECTRICAS",
    "ESPECIALISTA EN INSTALACIONES MECANICAS", "ESPECIALISTA EN INSTALACIONES ELECTROMECANICAS", "ESPECIALISTA EN INSTALACIONES", "ESPECIALISTA EN COMUNICACIONES", "ESPECIALISTA EN COMUNICACIONES Y CABLEADO",
    "ESPECIALISTA EN GASES MEDICINALES", "ESPECIALISTA EN GAS NATURAL", "ESPECIALISTA EN EQUIPAMIENTO HOSPITALARIO", "ESPECIALISTA EN EQUIPAMIENTO MEDICO", "ESPECIALISTA EN EQUIPAMIENTO",
    "ESPECIALISTA EN CONTROL Y ASEGURAMIENTO DE LA CALIDAD", "ESPECIALISTA EN CONTROL DE CALIDAD", "ESPECIALISTA EN ASEGURAMIENTO DE CALIDAD", "ESPECIALISTA EN SEGURIDAD Y SALUD EN EL TRABAJO",
    "ESPECIALISTA EN SEGURIDAD Y SALUD", "ESPECIALISTA EN SEGURIDAD", "ESPECIALISTA EN MEDIO AMBIENTE", "ESPECIALISTA AMBIENTAL", "ESPECIALISTA EN GESTION AMBIENTAL",
    "ESPECIALISTA EN COSTOS, METRADOS Y VALORIZACIONES", "ESPECIALISTA EN COSTOS Y VALORIZACIONES", "ESPECIALISTA EN COSTOS Y PRESUPUESTOS", "ESPECIALISTA EN METRADOS Y COSTOS", "ESPECIALISTA EN COSTOS",
    "ESPECIALISTA EN PROGRAMACION DE OBRA", "ESPECIALISTA EN PLANIFICACION", "ESPECIALISTA EN GEOTECNIA", "ESPECIALISTA EN MECANICA DE SUELOS", "ESPECIALISTA EN GEOLOGIA", "ESPECIALISTA EN PAVIMENTOS",
    "ESPECIALISTA BIM", "ESPECIALISTA EN BIM", "COORDINADOR BIM", "ESPECIALISTA EN INFRAESTRUCTURA HOSPITALARIA", "ESPECIALISTA SOCIAL", "ESPECIALISTA EN GESTION SOCIAL",
    "ESPECIALISTA EN VIGILANCIA TECNOLOGICA", "ESPECIALISTA EN PUESTA EN MARCHA",
)

#: Alerts: code -> severity.
ALERTS = {"ALT01": "WARNING", "ALT02": "WARNING", "ALT03": "WARNING", "ALT04": "CRITICAL", "ALT05": "CRITICAL", "ALT06": "CRITICAL", "ALT07": "CRITICAL", "ALT08": "CRITICAL", "ALT09": "WARNING"}

MONTHS = {
    "enero": 1, "ene": 1, "febrero": 2, "feb": 2, "marzo": 3, "mar": 3, "abril": 4, "abr": 4, "mayo": 5, "may": 5, "junio": 6, "jun": 6, "julio": 7, "jul": 7, "agosto": 8, "ago": 8,
    "septiembre": 9, "setiembre": 9, "sep": 9, "set": 9, "octubre": 10, "oct": 10, "noviembre": 11, "nov": 11, "diciembre": 12, "dic": 12,
}

COVID = ("2020-03-16", "2021-12-31")
TYPE_THRESHOLD = 3.0
MAX_PAGE_GAP = 4
ROLE_JACCARD = 0.4
NAME_JACCARD = 0.6
LINK_SCORE = 15.0
LINK_LEAD = 5.0

#: Words of work names that tell nothing, kinds of buildings, and words that are no name of a place.
WORK_STOP_WORDS = (
    "MEJORAMIENTO", "AMPLIACION", "CONSTRUCCION", "CREACION", "REHABILITACION", "REMODELACION", "INSTALACION", "RECUPERACION", "DE", "DEL", "LA", "LAS", "LOS", "EL", "EN", "AL", "CON", "PARA", "POR", "A", "UN", "UNA", "Y", "O", "E",
    "SERVICIOS", "SALUD", "OBRA", "PROYECTO", "EJECUCION", "SUPERVISION", "CONSULTORIA", "SERVICIO", "CAPACIDAD", "RESOLUTIVA", "PRESTACION", "ACCESO",
)
WORK_KINDS = ("HOSPITAL", "CENTRO", "ESTABLECIMIENTO", "POSTA", "CLINICA", "COLEGIO", "ESCUELA", "UNIVERSIDAD", "CARRETERA", "PUENTE", "ESTADIO", "COLISEO", "PALACIO", "MUNICIPALIDAD")
NO_PLACES = ("APOYO", "NIVEL", "ATENCION", "SEGUNDO", "REGIONAL")

#: Page signals, class -> (pattern over lower-case text without accents, weight). Accents are left out of the patterns as out of the text.
SIGNALS: dict[str, tuple[tuple[str, float], ...]] = {
    "rtm_postor": (("debe acreditar", 3.0), ("monto facturado", 3.0), ("experiencia.{0,20}postor", 2.5), ("obra.{0,20}similar|servicio.{0,20}similar", 2.0), ("no menor de", 1.5), ("requisito.{0,15}minimo", 1.5), ("descalifica", 2.0), ("acumulado.{0,20}equivalente", 2.0), ("contrato.{0,30}ejecutad", 1.0)),
    "rtm_personal": (("personal clave", 3.0), ("colegiatur|colegiado", 2.5), ("habilitad", 2.0), ("tiempo de experiencia", 2.5), ("titulo profesional", 2.0), ("puesto.{0,20}cargo|cargo.{0,20}denominaci", 1.5), ("especialista en", 1.5), ("jefe de|coordinador|residente", 1.0), (r"cant\.", 1.0), ("grado.{0,20}titulo", 1.5)),
    "factores_evaluacion": (("factor.{0,20}evaluaci", 3.0), ("puntaje.{0,20}maximo", 2.5), (r"\d+\s+puntos", 2.0), ("criterio.{0,20}evaluaci", 2.0), ("se otorga|se asigna", 1.5), ("porcentaje.{0,20}personal", 2.0), ("supere.{0,20}tiempo|supere.{0,20}experiencia", 2.0), ("metodolog.{0,20}asignaci", 2.0)),
    "capacitacion": (("capacitacion.{0,30}personal clave", 4.0), ("capacitacion requerida", 3.0), ("programa y/o curso y/o diplomado", 3.0), ("especializacion.{0,20}min", 2.5), ("duracion minima.{0,20}horas", 2.5), ("horas academicas", 2.0), (r"\d+\s*horas?\s*academicas", 2.5), ("curso de especializacion", 2.0)),
    "blacklist": (
        ("clausula", 2.5), ("esta seccion no debe ser modificada", 3.0), ("garantia.{0,20}fiel cumplimiento", 2.0), ("penalidad", 1.5), ("perfeccionamiento del contrato", 2.0),
        ("disposiciones comunes", 2.0), ("adelanto directo", 1.5), ("declaracion jurada", 1.5), (r"firma\s+(?:y\s+)?sello", 2.5), (r"datos\s+del\s+postor", 2.0),
        ("denominacion.{0,60}monto.{0,60}fecha", 3.0), (r"declaracion\s+jurada\s+de\s+.{0,60}(?:experiencia|proveedor|ejecutor|postor)", 3.0), ("estructura de costos", 3.0),
        ("precio de la oferta", 2.5), ("promesa de consorcio", 2.5), ("eleccion de institucion arbitral", 2.5), ("constancia de capacidad", 1.5), (r"señores\s+evaluadores", 1.5),
        (r"presente\.?-", 1.5), ("consignar segun corresponda", 2.0), ("postor ganador de la buena pro", 2.5), ("mesa de partes", 2.0), ("firma.{0,10}digital", 1.5),
        (r"plazo.{0,20}articulo.{0,10}\d+.{0,15}reglamento", 2.0), ("suscripcion del contrato", 2.0), ("cuenta.{0,10}interbancaria", 2.0), ("sin precalificacion", 3.0),
        ("admision de.{0,20}ofertas", 2.0), ("evaluacion de ofertas economicas", 2.5), ("pladicop", 2.0), ("puntaje minimo.{0,20}evaluacion tecnica", 2.0), ("el consultor debera", 2.0),
        ("el contratista debera", 2.0), ("plan de trabajo", 1.5), ("plan de ejecucion bim", 2.0), ("entregable", 1.5), ("informe quincenal", 1.5), ("oferta economica limitada", 2.5),
        ("cuantia.{0,20}contratacion", 2.0), ("determinacion de los limites", 2.0), ("cenepred", 3.0), ("cotizaciones.{0,30}firmadas", 2.0), ("reglamento nacional de edificaciones", 1.5),
        ("software nativo", 1.5), (r"anexo\s+n[°º]\s*\d+", 2.5), (r"formato\s+n[°º]\s*\d+", 2.5), (r"modelo\s+de\s+carta", 2.0), (r"n[°º]\s*contrato", 2.5),
        ("monto.{0,20}facturado.{0,20}acumulado", 3.0), (r"fecha de(?:l)?\s+contrato", 1.5), ("nombres y apellidos", 2.5), ("documento de identidad", 2.0),
        ("universidad.{0,20}institucion educativa", 2.0), ("personal no clave", 3.0), (r"asistente\s+(?:de|en)\s+\w", 2.0), (r"bachiller\s+en", 2.0),
        ("contabilizada desde la emision del grado", 2.5),
    ),
}
