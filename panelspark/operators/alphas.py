"""The 101 formulaic price-volume signals as expression trees.

Names: O, H, L, C, V and W are open, high, low, adjusted close, volume and the mean of H, L and C; r is the
change of C. The maximum or minimum of two matrices in some signals is taken over the whole section
(`compat`, the default) or per instrument (`paper`).
"""

from __future__ import annotations

from panelspark.functions.expr import Node, col, dw, ew, tw

E = 1e-10

O, H, L, C, V = (col(x) for x in ("open", "high", "low", "adj_close", "volume"))
W = (H + L + C) / 3
MID = (H + L) / 2


def R(x):
    return dw("rank", x)


def s(n, x):
    return tw("sum", x, n=n)


def m(n, x):
    return tw("sma", x, n=n)


def sd(n, x):
    return tw("std", x, n=n)


def mn(n, x):
    return tw("tmin", x, n=n)


def mx(n, x):
    return tw("tmax", x, n=n)


def am(n, x):
    return tw("argmax", x, n=n)


def an(n, x):
    return tw("argmin", x, n=n)


def d(n, x):
    return tw("delta", x, n=n)


def lag(n, x):
    return tw("lag", x, n=n)


def tr(n, x):
    return tw("tsrank", x, n=n)


def rawco(n, x, y):
    return tw("corr", x, y, n=n)


def co(n, x, y):
    return nz(rawco(n, x, y))


def cv(n, x, y):
    return tw("cov", x, y, n=n)


def dl(n, x):
    full = tw("filled", x)
    return tw("weighted", full, full, n=n)


def adv(n):
    return m(n, V)


def nz(x):
    return ew("fill", x, 0)


def iif(p, a, b):
    return ew("if", p, a, b)


def absolute(x):
    return ew("abs", x)


def sign(x):
    return ew("sign", x)


def zero_to(x, y):
    return ew("zero_to", x, y)


FILLED = tw("ffill", C)
#: Gaps are filled forward before the change is taken.
r = FILLED / lag(1, FILLED) - 1


def alphas(mode: str = "compat") -> dict[str, Node]:
    """Number -> tree. mode `paper` scales and takes maxima as published, not as the compatible form does."""
    compat = mode == "compat"

    def Z(x):
        return tw("scale", x) if compat else dw("day_scale", x)

    def top(a, b):
        x = ew("max", a, b)
        return nz(dw("day_max", x) if compat else x)

    def low(a, b):
        x = ew("min", a, b)
        return nz(dw("day_min", x) if compat else x)

    slope = (lag(20, C) - lag(10, C)) / 10 - (lag(10, C) - C) / 10
    d1 = d(1, C)
    gap = (C - L) - (H - C)
    f = {
        1: R(am(5, iif(r < 0, sd(20, r), C) ** 2)) - 0.5,
        2: nz(-rawco(6, R(d(2, ew("log", V + E))), R((C - O) / (O + E)))),
        3: -rawco(10, R(O), R(V)),
        4: -tr(9, R(L)),
        5: R(O - s(10, W) / 10) * -absolute(R(C - W)),
        6: nz(-rawco(10, O, V)),
        7: iif(adv(20) >= V, -1, -tr(60, absolute(d(7, C))) * sign(d(7, C))),
        9: iif((mn(5, d1) > 0) | (mx(5, d1) < 0), d1, -d1),
        10: R(iif((mn(4, d1) > 0) | (mx(4, d1) < 0), d1, -d1)),
        11: (R(mx(3, W - C)) + R(mn(3, W - C))) * R(d(3, V)),
        12: sign(d(1, V)) * -d1,
        13: -R(cv(5, R(C), R(V))),
        14: -R(d(3, r)) * co(10, O, V),
        15: -s(3, R(co(3, R(H), R(V)))),
        16: -R(cv(5, R(H), R(V))),
        17: -R(tr(10, C)) * R(d(1, d1)) * R(tr(5, V / (adv(20) + E))),
        18: -R(sd(5, absolute(C - O)) + (C - O) + co(10, C, O)),
        19: -sign((C - lag(7, C)) + d(7, C)) * (1 + R(1 + s(250, r))),
        20: -R(O - lag(1, H)) * R(O - lag(1, C)) * R(O - lag(1, L)),
        21: iif((m(8, C) + sd(8, C) < m(2, C)) | (adv(20) / (V + E) < 1), -1, 1),
        22: -d(5, co(5, H, V)) * R(sd(20, C)),
        23: iif(m(20, H) < H, -nz(d(2, H)), 0),
        24: iif(d(100, m(100, C)) / (lag(100, C) + E) <= 0.05, -(C - mn(100, C)), -d(3, C)),
        25: R(-r * adv(20) * W * (H - C)),
        26: -mx(3, co(5, tr(5, V), tr(5, H))),
        27: iif(R(m(2, co(6, R(V), R(W))) / 2) > 0.5, -1, 1),
        28: Z(co(5, adv(20), L) + MID - C),
        29: mn(5, R(R(Z(ew("log0", s(2, R(R(-R(d(5, C - 1)))))))))) + tr(5, lag(6, -r)),
        30: (1 - R(sign(d1) + sign(lag(1, d1)) + sign(lag(2, d1)))) * s(5, V) / (s(20, V) + E),
        31: R(R(R(dl(10, -R(R(d(10, C))))))) + R(-d(3, C)) + sign(Z(co(12, adv(20), L))),
        32: Z(m(7, C) / 7 - C) + 20 * Z(co(230, W, lag(5, C))),
        33: R(-1 + O / (C + E)),
        34: R(2 - R(ew("fill", sd(2, r) / (sd(5, r) + E), 1)) - R(d1)),
        35: tr(32, V) * (1 - tr(16, C + H - L)) * (1 - tr(32, r)),
        36: 2.21 * R(rawco(15, C - O, lag(1, V))) + 0.7 * R(O - C) + 0.73 * R(tr(5, lag(6, -r))) + R(absolute(co(6, W, adv(20)))) + 0.6 * R((m(200, C) / 200 - O) * (C - O)),
        37: R(co(200, lag(1, O - C), C)) + R(O - C),
        38: -R(tr(10, C)) * R(ew("fill", C / (O + E), 1)),
        39: -R(d(7, C) * (1 - R(dl(9, V / (adv(20) + E))))) * (1 + R(s(250, r))),
        40: -R(sd(10, H)) * co(10, H, V),
        41: (H * L) ** 0.5 - W,
        42: R(W - C) / (R(W + C) + E),
        43: tr(20, V / (adv(20) + E)) * tr(8, -d(7, C)),
        44: -co(5, H, R(V)),
        45: -R(m(20, lag(5, C))) * co(2, C, V) * R(co(2, s(5, C), s(20, C))),
        46: iif(slope > 0.25, -1, iif(slope < 0, 1, -d1)),
        47: R(1 / (C + E)) * V / (adv(20) + E) * (H * R(H - C) / (m(5, H) / 5 + E)) - R(W - lag(5, W)),
        48: co(250, d1, d(1, lag(1, C))) * d1 / (C + E),
        49: iif(slope < -0.1, 1, -d1),
        50: -mx(5, R(co(5, R(V), R(W)))),
        51: iif(slope < -0.05, 1, -d1),
        52: -d(5, mn(5, L)) * R((s(240, r) - s(20, r)) / 220) * tr(5, V),
        53: -d(9, gap / zero_to(C - L, 0.0001)),
        54: -(L - C) * O**5 / (zero_to(L - H, -0.0001) * C**5 + E),
        55: -co(6, R((C - mn(12, L)) / zero_to(mx(12, H) - mn(12, L), 0.0001)), R(V)),
        56: -R(s(10, r) / (m(3, s(2, r)) + E)) * R(r),
        57: -(C - W) / (dl(2, R(am(30, C))) + E),
        58: -tr(5, dl(8, co(4, W, V))),
        59: -tr(8, dl(16, co(4, W, V))),
        60: -(2 * Z(R(gap * V / zero_to(H - L, 0.0001))) - Z(R(am(10, C)))),
        61: R(W - mn(16, W)) < R(co(18, W, adv(180))),
        62: -(R(co(10, W, m(22, adv(20)))) < R(2 * R(O) < R(MID) + R(H))),
        63: -(R(dl(8, d(2, C))) - R(dl(12, co(14, W * 0.318108 + O * 0.681892, m(37, adv(180)))))),
        64: -(R(co(17, m(13, O * 0.178404 + L * 0.821596), m(13, adv(120)))) < R(d(4, MID * 0.178404 + W * 0.821596))),
        65: -(R(co(6, O * 0.00817205 + W * 0.99182795, m(9, adv(60)))) < R(O - mn(14, O))),
        66: -(R(dl(7, d(4, W))) + tr(7, dl(11, (L - W) / (O - MID + E)))),
        67: -(R(H - mn(2, H)) ** R(co(6, W, adv(20)))),
        68: nz(-(tr(14, co(9, R(H), R(adv(15)))) < R(d(1, C * 0.518371 + L * 0.481629)))),
        69: -(R(mx(5, d(3, W))) ** tr(9, co(5, C * 0.490655 + W * 0.509345, adv(20)))),
        70: -(R(d(1, W)) ** tr(18, co(18, C, adv(50)))),
        71: top(tr(16, dl(4, co(18, tr(3, C), tr(12, adv(180))))), tr(4, dl(16, R(L + O - (W + W)) ** 2))),
        72: R(dl(10, co(9, MID, adv(40)))) / (R(dl(3, co(7, tr(4, W), tr(19, V)))) + E),
        75: R(co(4, W, V)) < R(co(12, R(L), R(adv(50)))),
        76: -top(R(dl(12, d(1, W))), tr(19, dl(17, tr(20, co(8, L, adv(81)))))),
        77: low(R(dl(20, MID + H - (W + H))), R(dl(6, co(3, MID, adv(40))))),
        78: R(co(7, s(20, L * 0.352233 + W * 0.647767), s(20, adv(40)))) ** R(co(6, R(W), R(V))),
        79: R(d(1, C * 0.60733 + O * 0.39267)) < R(co(15, tr(4, W), tr(9, adv(150)))),
        80: -(R(sign(d(4, O * 0.868128 + H * 0.131872))) ** tr(6, co(5, H, adv(10)))),
        81: -(R(ew("log0", tw("product", R(R(co(8, W, s(50, adv(10)))) ** 4), n=15))) < R(co(5, R(W), R(V)))),
        82: -low(R(dl(15, d(1, O))), tr(13, dl(7, co(17, V, O)))),
        84: tr(21, W - mx(15, W)) ** d(5, C),
        85: R(co(10, H * 0.876703 + C * 0.123297, adv(30))) ** R(co(7, tr(4, MID), tr(10, V))),
        86: nz(-(tr(20, co(6, C, m(15, adv(20)))) < R((O + C) - (W + O)))),
        87: -top(R(dl(3, d(2, C * 0.369701 + W * 0.630299))), tr(14, dl(5, absolute(co(13, adv(81), C))))),
        89: tr(4, dl(6, co(7, L, adv(10)))) - tr(15, dl(10, d(3, W))),
        90: -(R(C - mx(5, C)) ** tr(3, co(5, adv(40), L))),
        91: -(tr(5, dl(4, dl(16, co(10, C, V)))) - R(dl(3, co(4, W, adv(30))))),
        92: low(tr(19, dl(15, MID + C < L + O)), tr(7, dl(7, co(8, R(L), R(adv(30)))))),
        93: tr(8, dl(20, co(17, W, adv(81)))) / (R(dl(16, d(3, C * 0.524434 + W * 0.475566))) + E),
        94: -(R(W - mn(12, W)) ** tr(3, co(18, tr(20, W), tr(4, adv(60))))),
        95: R(O - mn(12, O)) < tr(12, R(co(13, m(19, MID), m(19, adv(40)))) ** 5),
        96: -top(tr(8, dl(4, co(4, R(W), R(V)))), tr(13, dl(14, am(13, co(4, tr(7, C), tr(4, adv(60))))))),
        97: -(R(dl(20, d(3, L * 0.721001 + W * 0.278999))) - tr(7, dl(16, tr(19, co(5, tr(8, L), tr(17, adv(60))))))),
        98: R(dl(7, co(5, W, m(26, adv(5))))) - R(dl(8, tr(7, an(9, co(21, R(O), R(adv(15))))))),
        99: -(R(co(9, s(20, MID), s(20, adv(60)))) < R(co(6, L, V))),
        101: (C - O) / ((H - L) + 0.001),
    }
    q8 = s(5, O) * s(5, r)
    f[8] = -R(q8 - lag(10, q8))
    q73 = O * 0.147155 + L * 0.852845
    f[73] = -top(R(dl(3, d(5, W))), tr(17, dl(3, -(d(2, q73) / (q73 + E)))))
    f[74] = -(R(co(15, C, m(37, adv(30)))) < R(co(11, R(H * 0.0261661 + W * 0.9738339), R(V))))
    q83 = (H - L) / (s(5, C) / 5 + E)
    f[83] = R(lag(2, q83)) * R(R(V)) / (q83 / (W - C + E) + E)
    a88, b88 = R(dl(8, R(O) + R(L) - R(H) - R(C))), tr(3, dl(7, co(8, tr(8, C), tr(21, adv(60)))))
    f[88] = dw("day_min", ew("min", a88, b88)) if compat else ew("min", a88, b88)
    q100 = gap / (H - L + E) * V
    f[100] = -((1.5 * Z(R(q100)) - Z(co(5, C, R(adv(20))) - R(an(30, C)))) * V / (adv(20) + E))
    return {f"alpha{k:03d}": f[k] for k in sorted(f)}
