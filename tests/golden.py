"""A published television series by age and its published smooth."""

AGES = (*range(15, 81), 85)

MALE = (
    132.2829, 128.8051, 135.5826, 135.1207, 153.3860, 136.8587, 138.4555, 150.2121, 133.5821,
    151.1979, 135.0231, 133.5591, 143.4505, 145.4783, 145.2731, 129.4594, 139.9591, 146.0113,
    140.3863, 154.9953, 144.4928, 139.5195, 146.5309, 139.3003, 148.3951, 140.7363, 139.6058,
    150.8403, 148.7630, 154.1129, 159.1725, 164.4247, 173.8143, 163.5882, 166.4861, 167.0304,
    181.9194, 187.9087, 166.7085, 195.2293, 182.3255, 198.6729, 200.0382, 188.9228, 214.4105,
    198.7728, 218.7983, 227.5516, 243.3904, 241.8354, 256.4582, 261.5501, 253.6216, 267.8524,
    260.8877, 271.4527, 282.3220, 272.5638, 268.2811, 259.3131, 276.2650, 273.4831, 288.8475,
    299.5535, 274.9968, 284.3582, 311.4236,
)

MALE_SMOOTH = (
    139.9171, 139.3612, 138.8882, 138.4952, 138.1792, 137.9370, 137.7657, 137.6622, 137.6234,
    137.6431, 137.7224, 137.8697, 138.0935, 138.4021, 138.8040, 139.3076, 139.9212, 140.5722,
    141.2053, 141.8552, 142.5567, 143.3445, 144.2534, 145.3181, 146.5733, 148.0538, 149.6615,
    151.3060, 153.0337, 154.8909, 156.9240, 159.1793, 161.7032, 164.5420, 167.8161, 171.5526,
    175.6583, 180.0396, 184.6031, 189.2556, 193.9034, 198.4533, 202.8118, 207.1919, 211.8105,
    216.5800, 221.4126, 226.2207, 230.9167, 235.4128, 239.6215, 243.6660, 247.7160, 251.7530,
    255.7585, 259.7141, 263.6013, 267.4017, 271.0969, 274.6872, 278.1874, 281.6008, 284.9306,
    288.1798, 291.3516, 294.4493, 308.9361,
)
