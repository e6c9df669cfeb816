"""The drawing language: shapes, colours, matrices, text and tags as a list of commands, compiled to a page's operators.

A command is its name and its operands, one a line: ``rect 10 10 100 50``,
``fillcol red``, ``fill``.  Names follow the options of the command line.
"""

from __future__ import annotations

import math

# Colours by name, red, green and blue of 255.
COLOURS = {
    "aliceblue": "f0f8ff", "antiquewhite": "faebd7", "aqua": "00ffff", "aquamarine": "7fffd4", "azure": "f0ffff", "beige": "f5f5dc", "bisque": "ffe4c4", "black": "000000", "blanchedalmond": "ffebcd", "blue": "0000ff",
    "blueviolet": "8a2be2", "brown": "a52a2a", "burlywood": "deb887", "cadetblue": "5f9ea0", "chartreuse": "7fff00", "chocolate": "d2691e", "coral": "ff7f50", "cornflowerblue": "6495ed", "cornsilk": "fff8dc", "crimson": "dc143c",
    "cyan": "00ffff", "darkblue": "00008b", "darkcyan": "008b8b", "darkgoldenrod": "b8860b", "darkgray": "a9a9a9", "darkgreen": "006400", "darkgrey": "a9a9a9", "darkkhaki": "bdb76b", "darkmagenta": "8b008b", "darkolivegreen": "556b2f",
    "darkorange": "ff8c00", "darkorchid": "9932cc", "darkred": "8b0000", "darksalmon": "e9967a", "darkseagreen": "8fbc8f", "darkslateblue": "483d8b", "darkslategray": "2f4f4f", "darkslategrey": "2f4f4f", "darkturquoise": "00ced1", "darkviolet": "9400d3",
    "deeppink": "ff1493", "deepskyblue": "00bfff", "dimgray": "696969", "dimgrey": "696969", "dodgerblue": "1e90ff", "firebrick": "b22222", "floralwhite": "fffaf0", "forestgreen": "228b22", "fuchsia": "ff00ff", "gainsboro": "dcdcdc",
    "ghostwhite": "f8f8ff", "gold": "ffd700", "goldenrod": "daa520", "gray": "808080", "green": "008000", "greenyellow": "adff2f", "grey": "808080", "honeydew": "f0fff0", "hotpink": "ff69b4", "indianred": "cd5c5c",
    "indigo": "4b0082", "ivory": "fffff0", "khaki": "f0e68c", "lavender": "e6e6fa", "lavenderblush": "fff0f5", "lawngreen": "7cfc00", "lemonchiffon": "fffacd", "lightblue": "add8e6", "lightcoral": "f08080", "lightcyan": "e0ffff",
    "lightgoldenrodyellow": "fafad2", "lightgray": "d3d3d3", "lightgreen": "90ee90", "lightgrey": "d3d3d3", "lightpink": "ffb6c1", "lightsalmon": "ffa07a", "lightseagreen": "20b2aa", "lightskyblue": "87cefa", "lightslategray": "778899", "lightslategrey": "778899",
    "lightsteelblue": "b0c4de", "lightyellow": "ffffe0", "lime": "00ff00", "limegreen": "32cd32", "linen": "faf0e6", "magenta": "ff00ff", "maroon": "800000", "mediumaquamarine": "66cdaa", "mediumblue": "0000cd", "mediumorchid": "ba55d3",
    "mediumpurple": "9370db", "mediumseagreen": "3cb371", "mediumslateblue": "7b68ee", "mediumspringgreen": "00fa9a", "mediumturquoise": "48d1cc", "mediumvioletred": "c71585", "midnightblue": "191970", "mintcream": "f5fffa", "mistyrose": "ffe4e1", "moccasin": "ffe4b5",
    "navajowhite": "ffdead", "navy": "000080", "oldlace": "fdf5e6", "olive": "808000", "olivedrab": "6b8e23", "orange": "ffa500", "orangered": "ff4500", "orchid": "da70d6", "palegoldenrod": "eee8aa", "palegreen": "98fb98",
    "paleturquoise": "afeeee", "palevioletred": "db7093", "papayawhip": "ffefd5", "peachpuff": "ffdab9", "peru": "cd853f", "pink": "ffc0cb", "plum": "dda0dd", "powderblue": "b0e0e6", "purple": "800080", "red": "ff0000",
    "rosybrown": "bc8f8f", "royalblue": "4169e1", "saddlebrown": "8b4513", "salmon": "fa8072", "sandybrown": "f4a460", "seagreen": "2e8b57", "seashell": "fff5ee", "sienna": "a0522d", "silver": "c0c0c0", "skyblue": "87ceeb",
    "slateblue": "6a5acd", "slategray": "708090", "slategrey": "708090", "snow": "fffafa", "springgreen": "00ff7f", "steelblue": "4682b4", "tan": "d2b48c", "teal": "008080", "thistle": "d8bfd8", "tomato": "ff6347",
    "turquoise": "40e0d0", "violet": "ee82ee", "wheat": "f5deb3", "white": "ffffff", "whitesmoke": "f5f5f5", "yellow": "ffff00", "yellowgreen": "9acd32",
}
#: Fixed value: how far a quarter circle's control points lie from its ends.
KAPPA = 4 * (math.sqrt(2) - 1) / 3

#: Commands that are one operator with their operands before it: operator and how many.
_PLAIN = {
    "to": ("m", 2), "line": ("l", 2), "bez": ("c", 6), "bez23": ("v", 4), "bez13": ("y", 4), "rect": ("re", 4), "close": ("h", 0), "stroke": ("S", 0), "fill": ("f", 0), "filleo": ("f*", 0), "strokefill": ("B", 0),
    "strokefilleo": ("B*", 0), "clip": ("W n", 0), "clipeo": ("W* n", 0), "thick": ("w", 1), "miter": ("M", 1), "push": ("q", 0), "pop": ("Q", 0), "matrix": ("cm", 6), "leading": ("TL", 1), "charspace": ("Tc", 1),
    "wordspace": ("Tw", 1), "textscale": ("Tz", 1), "rendermode": ("Tr", 1), "rise": ("Ts", 1), "nl": ("T*", 0), "bt": ("BT", 0), "et": ("ET", 0), "endtag": ("EMC", 0), "endartifact": ("EMC", 0),
}
_CAPS, _JOINS = {"butt": 0, "round": 1, "square": 2}, {"miter": 0, "round": 1, "bevel": 2}


def colour(text: str) -> tuple[float, ...]:
    """The components of a colour: a name, or one (grey), three or four numbers from 0 to 1."""
    name = text.strip().lower()
    if name in COLOURS:
        return tuple(int(COLOURS[name][k : k + 2], 16) / 255 for k in (0, 2, 4))
    parts = tuple(float(p) for p in text.split())
    if len(parts) not in (1, 3, 4):
        raise ValueError(f"no colour: {text!r}")
    return parts


def number(x: float) -> str:
    """A number as operators have it."""
    return f"{x:.6f}".rstrip("0").rstrip(".").replace("-0", "0") if abs(x) < 5e-7 else f"{x:.6f}".rstrip("0").rstrip(".")


def circle(x: float, y: float, r: float) -> list[str]:
    """A circle as four curves, from its right end against the clock."""
    k = r * KAPPA
    curves = [(x + r, y + k, x + k, y + r, x, y + r), (x - k, y + r, x - r, y + k, x - r, y), (x - r, y - k, x - k, y - r, x, y - r), (x + k, y - r, x + r, y - k, x + r, y)]
    return [f"{number(x + r)} {number(y)} m", *(" ".join(map(number, c)) + " c" for c in curves)]


def _turn(degrees: float) -> tuple[float, float]:
    return math.cos(math.radians(degrees)), math.sin(math.radians(degrees))


def _quoted(text: str) -> str:
    return "(" + text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ")"


def compiled(program: str) -> list[str]:
    """The operators of each page of a drawing: "newpage" begins another; an unknown command is an error, an open state is closed."""
    pages: list[list[str]] = [[]]
    depth = 0
    for line in program.split("\n"):
        command, _, rest = line.strip().partition(" ")
        made = pages[-1]
        if not command or command.startswith("#"):
            continue
        if command == "newpage":
            made += ["Q"] * depth
            depth = 0
            pages.append([])
            continue
        words = rest.split()
        if command in _PLAIN:
            operator, n = _PLAIN[command]
            if len(words) != n:
                raise ValueError(f"{command} has {n} operands: {line!r}")
            depth += (operator == "q") - (operator == "Q")
            made.append(" ".join([*(number(float(w)) for w in words), operator]))
        elif command == "circle":
            made += circle(*map(float, words))
        elif command in ("strokecol", "fillcol"):
            parts = colour(rest)
            operator = {1: "g", 3: "rg", 4: "k"}[len(parts)]
            made.append(" ".join([*map(number, parts), operator.upper() if command == "strokecol" else operator]))
        elif command == "cap":
            made.append(f"{_CAPS[rest.strip()]} J")
        elif command == "join":
            made.append(f"{_JOINS[rest.strip()]} j")
        elif command == "dash":
            made.append("[" + " ".join(number(float(w)) for w in words) + "] 0 d")
        elif command == "mtrans":
            x, y = map(float, words)
            made.append(f"1 0 0 1 {number(x)} {number(y)} cm")
        elif command == "mrot":
            x, y, degrees = map(float, words)
            c, s = _turn(degrees)
            made.append(" ".join(map(number, (c, s, -s, c, x - x * c + y * s, y - x * s - y * c))) + " cm")
        elif command == "mscale":
            x, y, sx, sy = map(float, words)
            made.append(" ".join(map(number, (sx, 0, 0, sy, x - sx * x, y - sy * y))) + " cm")
        elif command in ("mshearx", "msheary"):
            x, y, degrees = map(float, words)
            t = math.tan(math.radians(degrees))
            made.append(" ".join(map(number, (1, 0, t, 1, -t * y, 0) if command == "mshearx" else (1, t, 0, 1, 0, -t * x))) + " cm")
        elif command == "font":
            made.append(f"/{words[0]} {number(float(words[1]))} Tf")
        elif command == "text":
            made.append(f"{_quoted(rest)} Tj")
        elif command in ("use", "image"):
            made.append(f"/{words[0]} Do")
        elif command == "tag":
            made.append(f"/{words[0]} BMC")
        elif command == "artifact":
            made.append("/Artifact BMC")
        else:
            raise ValueError(f"no such command: {line!r}")
    pages[-1] += ["Q"] * depth
    return ["\n".join(p) for p in pages]
